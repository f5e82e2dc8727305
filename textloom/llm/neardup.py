"""Near-duplicate groups by HyperMinHash sketches, banded registers and exact confirmation.

Sketch. Each shingle hash falls into one of ``REGISTERS`` buckets; a bucket keeps its least hash, compressed to the count
of leading zeros and ten mantissa bits. Buckets that stay empty are filled in further rounds with other hashes, whose
number is part of the register, so two sets agree in a register with probability J whatever their sizes.
Candidates. Bands of five registers are bucket keys: at J = 0.75 all of the 48 bands of a pair differ with probability
2e-6. Equal sets are one node from the start. In each bucket every member meets a centre, the member that shares most
buckets with others, which joins nearly all of a group of near copies at the cost of a link each. The register estimate,
corrected for accidental collisions, drops pairs under 0.6 (five standard deviations); the rest are confirmed on the full
shingle sets. Where a bucket still holds several components, its members of different components are compared by their
registers inside a task, and only a spanning forest of what is near leaves it; all nodes of components that hang together
by it meet once more by registers, and those that are near another there meet with their full sets; again only a spanning
forest of confirmed links leaves the task. A group over ``BLOCK_ROWS`` is dealt out in pairs of blocks: of m members in b
blocks each travels to b tasks, so memory is bounded. Where that would move more rows than ``BANDS`` for each member, a
bucket is split first by bands of the registers in another order (a pair at J = 0.75 shares none of them with probability
2e-6 again), which part texts that have little but the bucket in common; what is as large after ``SPLITS`` turns is dealt
out in blocks all the same, so no pair is capped away. Full sets travel only with nodes that are near another in a task.
Components spread the smallest label along confirmed links, with pointer jumping.
Keys that hold many rows (buckets, hubs and labels of components, sets of copies) are dealt over pieces in every join.

Pairs already in one component aren't compared.
Null texts and texts without words are empty and linked with nothing; a text with fewer than five words is one shingle.
Null ids take part: a component's id is its smallest id that isn't null. Rows may repeat; each gets a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U64, buffers, digests, mix, ranges, shingles, word_bounds
from .scratch import HOT_KEYS, HOT_ROWS, Scratch, free_shuffles, hot_keys, small_batches, spread_join

REGISTERS, BANDS, MANTISSA = 240, 48, 10
BLOCK_ROWS, TASK_ROWS = 512, 1024
SPLIT_ROWS, SPLITS = BANDS * BLOCK_ROWS, 2
_VALUE_BITS = 48
_ROWS = REGISTERS // BANDS
_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0xD1B54A32D192ED03)
LEAST_ESTIMATE = 0.6


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text, A-Z lower-cased."""
    for i, j in ranges(off):
        part, o = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e, cut = word_bounds(part, o)
        h, at = shingles(digests(part, s, e), cut, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            x = np.sort(h[a:b])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def sketch(h: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes: round << 16 | leading zeros << 10 | mantissa.

    A round's hash gives a bucket by its high half and a value by the rest. A bucket takes the least value of the first
    round that reaches it; rounds are computed as many at a time as should fill all buckets. After ``REGISTERS`` rounds
    (few hashes) a bucket that is still empty takes the least value of a round of its own.
    """
    least = np.full(REGISTERS, ~U64(0), U64)  # round << 48 | value
    turn = 0
    while turn < REGISTERS and (least == ~U64(0)).any():
        many = min(REGISTERS - turn, -(-7 * REGISTERS // len(h)))
        g = mix(h[None, :] ^ _SEEDS[turn : turn + many, None])
        spread = (g >> U64(32)) * U64(REGISTERS)
        value = (spread & U64(0xFFFFFFFF)) << U64(16) | (g & U64(0xFFFFFFFF)) >> U64(16)
        key = np.sort(((spread >> U64(32)) << U64(56) | np.arange(turn, turn + many, dtype=np.uint64)[:, None] << U64(48) | value).ravel())
        bucket = (key >> U64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        bucket = bucket[first]
        least[bucket] = np.minimum(least[bucket], key[first] & U64((1 << 56) - 1))
        turn += many
    (empty,) = np.nonzero(least == ~U64(0))
    if len(empty):
        own = mix(h[None, :] ^ _SEEDS[REGISTERS + empty, None]).min(1) >> U64(16)
        least[empty] = U64(255) << U64(48) | own
    value = least & U64((1 << _VALUE_BITS) - 1)
    frac, exponent = np.frexp(value.astype(np.float64))
    zeros = np.minimum(_VALUE_BITS - exponent, 63).astype(np.uint32)
    mant = np.where(value > 0, (frac * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint32)
    return (least >> U64(48)).astype(np.uint32) << np.uint32(16) | zeros << np.uint32(MANTISSA) | mant


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (one row per pair), corrected for registers that agree by accident."""
    same = (a == b).mean(1)
    ratio = np.minimum(n, m) / np.maximum(n, m)
    accident = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (same - accident) / (1 - accident)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """The bucket keys of sketches (one row each)."""
    x = registers.reshape(-1, BANDS, _ROWS).astype(U64)
    key = np.repeat(_SALT[None, :], len(x), 0)
    for c in range(_ROWS):
        key = mix(key ^ x[:, :, c])
    return key


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            node, n, regs, bands = [], [], [], []
            for h in shingle_sets(data, off, k):
                n.append(len(h))
                if not len(h):
                    node.append(None), regs.append(None), bands.append([])
                    continue
                node.append(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True))
                r = sketch(h)
                regs.append(r.tobytes())
                bands.append(band_keys(r)[0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "key", "node", "n", "regs", "bands"],
            )

    return run


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            use = pa.array(estimate(a, b, n, m) >= LEAST_ESTIMATE)
            yield batch.select(["a", "b"]).filter(use)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            sets = [h.tobytes() for h in shingle_sets(data, off, k)]
            node = batch.column("node")
            fits = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) == x for s, x in zip(sets, node.to_pylist())]
            yield pa.RecordBatch.from_arrays([node, pa.array(sets, pa.binary())], names=["node", "hashes"]).filter(pa.array(fits, pa.bool_()))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                use.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(use, pa.bool_()))

    return run


class Forest:
    """Union by smaller name; keeps the links that joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


_CALLED = "node long, comp long, n long, regs binary, grp long, blk int, lo int, hi int, task long"


def _meetings(percent: int, what: str):
    """Tasks of block pairs: ``near`` gives near links between components, ``called`` the rows of nodes that are near one of
    another component, ``full`` the confirmed links between nodes."""
    full = what == "full"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        node, comp, n, blk, grp, lo, hi = (table.column(c).to_numpy() for c in ("node", "comp", "n", "blk", "grp", "lo", "hi"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint32).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()] if full else []
        edge = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
        forest, out, called = Forest(), [], np.zeros(len(node), bool)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            rows = np.arange(a, b)
            xs = rows if lo[a] == hi[a] else rows[blk[a:b] == lo[a]]
            ys = rows if lo[a] == hi[a] else rows[blk[a:b] == hi[a]]
            for i in range(0, len(xs), 64):
                x = xs[i : i + 64]
                test = (comp[x][:, None] != comp[ys][None, :]) & (100 * np.minimum(n[x][:, None], n[ys][None, :]) >= percent * np.maximum(n[x][:, None], n[ys][None, :]))
                if lo[a] == hi[a]:
                    test &= x[:, None] < ys[None, :]
                p, q = np.nonzero(test)
                for j in range(0, len(p), 8192):
                    u, v = x[p[j : j + 8192]], ys[q[j : j + 8192]]
                    near = estimate(regs[u], regs[v], n[u], n[v])
                    if what == "called":
                        called[u[near >= LEAST_ESTIMATE]] = called[v[near >= LEAST_ESTIMATE]] = True
                        continue
                    order = np.argsort(-near, kind="stable")
                    order = order[near[order] >= LEAST_ESTIMATE]
                    for s, t in zip(u[order].tolist(), v[order].tolist()):
                        c, d = int(comp[s]), int(comp[t])
                        if forest.find(c) == forest.find(d):
                            continue
                        if full:
                            z = np.sort(np.concatenate([sets[s], sets[t]]), kind="stable")
                            both = int((z[1:] == z[:-1]).sum())
                            if 100 * both < percent * (len(z) - both):
                                continue
                        forest.join(c, d)
                        out.append((int(node[s]), int(node[t])) if full else (c, d))
        if what == "called":
            return table.select(_CALLED.replace(",", "").split()[::2]).filter(pa.array(called))
        cols = list(zip(*out)) or [()] * 2
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def _split(turn: int):
    """The subordinate buckets of a bucket's members: its key with each band of the registers in another order."""
    order = np.random.default_rng(turn).permutation(REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint32).reshape(-1, REGISTERS)
                key = part.column("key").to_numpy().view(U64)
                new = mix(band_keys(regs[:, order]) ^ mix(key)[:, None]).ravel().view(np.int64)
                node, comp = (np.repeat(part.column(c).to_numpy(), BANDS) for c in ("node", "comp"))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (new, node, comp)], names=["key", "node", "comp"])

    return run


def _mixed(scratch: Scratch, held: DataFrame, name: str) -> DataFrame:
    """The members (key, node, comp) of buckets that hold several components."""
    mixed = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return scratch.write(spread_join(held, mixed, "key", hot_keys(scratch, held, "key", f"{name}-hot"), ["node"]).select("key", "node", "comp"), name)


def _parted(scratch: Scratch, mixed: DataFrame, placed: DataFrame) -> DataFrame:
    """Mixed buckets, those over ``SPLIT_ROWS`` replaced by subordinate ones."""
    done = []
    for turn in range(1, SPLITS + 1):
        large = scratch.write(mixed.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > SPLIT_ROWS).select("key"), f"large-{turn}")
        if not large.head(1):
            break
        done.append(mixed.join(large, "key", "left_anti"))
        hot = hot_keys(scratch, mixed, "key", f"large-{turn}-hot")
        members = spread_join(mixed, large, "key", hot, ["node"]).join(placed.select("node", "regs"), "node")
        parts = scratch.write(members.select("key", "node", "comp", "regs").mapInArrow(_split(turn), "key long, node long, comp long"), f"parts-{turn}")
        mixed = _mixed(scratch, parts, f"mixed-{turn}")
    for part in done:
        mixed = mixed.union(part.select("key", "node", "comp"))
    return scratch.write(mixed, "parted") if done else mixed


def _in_blocks(scratch: Scratch, rows: DataFrame, group: str) -> DataFrame:
    """Rows with grp, blk, lo, hi and task: every two rows of a group meet in one task; small groups share tasks."""
    sized = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nb"))
    tasks = max(1, rows.count() // TASK_ROWS)
    dealt = spread_join(rows, sized, group, hot_keys(scratch, rows, group, f"{group}-hot"), ["node"])
    dealt = dealt.withColumn("grp", F.col(group)).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    paired = paired.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    task = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.xxhash64("grp", "lo", "hi"))
    return paired.withColumn("task", task)


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """The smallest node reachable from each linked node; links: (a, b)."""
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), f"{name}-both")
    hubs = hot_keys(scratch, both, "other", f"{name}-hubs")
    labels = scratch.write(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        seen = labels.toDF("other", "theirs")
        near = spread_join(both, seen, "other", hubs, ["node"]).groupBy("node").agg(F.min("theirs").alias("theirs"))
        low = scratch.write(labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "theirs").alias("comp")), f"{name}-low-{step}")
        up = labels.toDF("comp", "further")
        hot = hot_keys(scratch, low, "comp", f"{name}-hot-{step}")
        step += 1
        new = scratch.write(spread_join(low, up, "comp", hot, ["node"]).select("node", "was", F.least("comp", "further").alias("comp")), f"{name}-{step}")
        done = not new.where("was <> comp").head(1)
        if step > 1:
            scratch.drop(f"{name}-{step - 2}", f"{name}-low-{step - 2}")
        labels = new.select("node", "comp")
        if done:
            return labels


def _classes(docs: DataFrame, text: str, ids: str, percent: int, k: int) -> tuple[Scratch, DataFrame, DataFrame]:
    """The folder, the rows (id, key of the text, node, n) and the nodes with their component's first row: by id, null last, then key."""
    if percent < 75 or k < 1:
        raise ValueError("bands and the register estimate are laid out for similarities of 75 per cent or more")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    base = docs.select(docs[ids].alias("id"), F.xxhash64(docs[text]).alias("key"), docs[text].alias("text"))
    kind = dict(base.dtypes)["id"]
    rows = scratch.write(base.mapInArrow(_sketches(k), f"id {kind}, key long, node long, n long, regs binary, bands array<long>"), "rows")
    # equal sets are one node
    row = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    nodes = scratch.write(
        rows.where("node is not null").groupBy("node").agg(F.min(row).alias("one"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "nodes"
    )
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = scratch.write(keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "shared")
    free_shuffles(spark)
    # of the buckets with several members those count as hot that hold a part of all bucket rows
    limit = max(HOT_ROWS, nodes.count() * BANDS // HOT_KEYS)
    hot = scratch.write(shared.where(F.col("many") > limit).select(F.col("key").alias("_hot"), F.ceil(F.col("many") / limit).cast("int").alias("_pieces")), "hot")
    hot = hot if hot.head(1) else None
    members = scratch.write(spread_join(keys, shared, "key", hot, ["node"]), "members")
    degree = members.groupBy("node").agg(F.sum("many").alias("degree"))
    centre = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).getField("node").alias("centre"))
    known = scratch.write(nodes.join(members.select("node").distinct(), "node").select("node", "one", "n", "regs"), "known")
    # by id and text: neither copies under many ids nor many texts under one id or null meet in one place
    texts = base.join(known.select("node", "one"), F.col("id").eqNullSafe(F.col("one.id")) & (F.col("key") == F.col("one.key"))).select("node", "text")
    sets = scratch.write(texts.mapInArrow(_sets(k), "node long, hashes binary").dropDuplicates(["node"]), "sets")
    free_shuffles(spark)

    def fits(n: str, m: str) -> F.Column:
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def pruned(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        right = known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        near = pairs.join(left, "a").join(right, "b").where(fits("na", "nb"))
        return scratch.write(near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_prune, "a long, b long"), name)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
        return scratch.write(full.mapInArrow(_confirm(percent), "a long, b long"), name)

    links = confirmed(pruned(spread_join(members, centre, "key", hot, ["node"]).where("node <> centre").select(F.col("node").alias("x"), F.col("centre").alias("y")), "tried"), "links")
    free_shuffles(spark)
    labels = components(scratch, links, "first")
    placed = scratch.write(known.join(labels, "node", "left").select("node", "n", "regs", F.coalesce("comp", "node").alias("comp")), "placed")
    held = scratch.write(members.select("key", "node").join(placed.select("node", "comp"), "node"), "held")
    mixed = _parted(scratch, _mixed(scratch, held, "mixed"), placed)
    met = _in_blocks(scratch, mixed.select("key", "node"), "key").join(placed, "node")
    near = met.groupBy("task").applyInArrow(_meetings(percent, "near"), "a long, b long")
    near = scratch.write(near.distinct(), "near")
    free_shuffles(spark)
    if near.head(1):
        hang = components(scratch, near, "hang").toDF("comp", "cluster")
        hot = hot_keys(scratch, placed, "comp", "placed-hot")
        close = scratch.write(spread_join(placed, hang, "comp", hot, ["node"]).select("node", "cluster"), "close")
        met = _in_blocks(scratch, close, "cluster").join(placed, "node")
        called = scratch.write(met.groupBy("task").applyInArrow(_meetings(percent, "called"), _CALLED), "called")
        late = called.join(sets, "node").groupBy("task").applyInArrow(_meetings(percent, "full"), "a long, b long")
        late = scratch.write(late, "late")
        free_shuffles(spark)
        if late.head(1):
            labels = components(scratch, links.union(late), "last")
    groups = labels.join(nodes.select("node", "one"), "node")
    least = groups.groupBy("comp").agg(F.min("one").alias("least"))
    found = spread_join(groups, least, "comp", hot_keys(scratch, labels, "comp", "labels-hot"), ["node"]).select("node", "least")
    first = F.coalesce("least", "one")
    classes = scratch.write(nodes.select("node", "one").join(found, "node", "left").select("node", first.alias("first"), (first == F.col("one")).alias("stays")), "classes")
    free_shuffles(spark)
    return scratch, rows, classes


def near_duplicates(docs: DataFrame, text: str = "text", ids: str = "doc_id", percent: int = 75, k: int = 5) -> DataFrame:
    """Per row: its id, n_shingles, component_id and kept (its id is the component's)."""
    scratch, rows, classes = _classes(docs, text, ids, percent, k)
    rows = rows.select("id", "key", "n", "node")
    sets = rows.where("node is not null")
    found = spread_join(sets, classes.select("node", F.col("first.id").alias("component_id")), "node", hot_keys(scratch, sets, "node", "copies-hot"), ["id", "key"])
    kind = dict(rows.dtypes)["id"]
    out = found.select("id", "n", "node", "component_id").union(rows.where("node is null").select("id", "n", "node", F.lit(None).cast(kind).alias("component_id")))
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(ids), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def one_of_each(docs: DataFrame, text: str = "text", ids: str = "doc_id", percent: int = 75, k: int = 5) -> DataFrame:
    """One whole row of each component, whatever ids are null or repeated, and every row without words."""
    _, _, classes = _classes(docs, text, ids, percent, k)
    stays = classes.where("stays").select(F.col("first.id").alias("_id"), F.col("first.key").alias("_first"))
    words = F.coalesce(docs[text], F.lit("")).rlike(r"[^ \x09-\x0D]")
    rows = docs.where(words).withColumn("_key", F.xxhash64(docs[text]))
    # rows equal in id and text are one component
    kept = rows.join(stays, rows[ids].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_first")), "left_semi").dropDuplicates([ids, "_key"])
    return kept.drop("_key").union(docs.where(~words))
