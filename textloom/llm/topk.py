"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors become integers floor(64 * x). Rows are packed into shards of ``SHARD_ROWS`` and queries into blocks of
``QUERY_ROWS``. A task holds ``GROUP_SHARDS`` shards, builds the tree of each once, and takes ``GROUP_BLOCKS`` blocks of
queries through them, so queries travel once for each group of shards and shards once for each group of blocks. The
current kth scores of a block's queries are carried from shard to shard: a node is entered only by queries whose bound
q.c + |q| r reaches their kth score, the child with the higher bound first, and a leaf is one matrix product. Every task
starts from kth scores that are known already: those of each query against a first group of shards. The k best of each
task are merged by rank.

Vectors that are null or hold null or non-finite components take no part; vectors of another length than the query's
neither. A query's own id is no candidate. Rows that repeat an id are one query, with the least of their vectors that take
part (the shortest, then by components), and each a candidate of the others. Ties go to the smaller id. Rows without an id
are left out. Scores are exact; those beyond 64 bits become the least or the
greatest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARD_ROWS, QUERY_ROWS, GROUP_SHARDS, GROUP_BLOCKS, LEAF_ROWS = 4096, 1024, 8, 16, 128
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BLOCK = "part long, dim int, ids binary, vectors binary, kind string"


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By dimension: row numbers and integer vectors of the rows that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    size = np.array([-1 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = values[start[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(x).all(1)
        out[dim] = rows[fine], np.floor(scale * x[fine])
    return size, out


def _pack(x: np.ndarray) -> tuple[bytes, str]:
    most = np.abs(x).max(initial=0)
    kind = "i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return x.astype(kind).tobytes(), kind


def _blocks(rows: int, scale: float, every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part = TaskContext.get().partitionId() << 32

        def full(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal part
            ids = np.concatenate([a for a, _ in held[dim]])
            x = np.concatenate([b for _, b in held[dim]])
            at = 0
            while len(ids) - at >= least:
                data, kind = _pack(x[at : at + rows])
                yield pa.RecordBatch.from_pydict({"part": [part], "dim": [dim], "ids": [ids[at : at + rows].tobytes()], "vectors": [data], "kind": [kind]}, pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string())]))
                part, at = part + 1, at + rows
            held[dim] = [(ids[at:], x[at:])]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim, (at, x) in integers(batch.column(1), scale)[1].items():
                if every:
                    use = ids[at] % every == 0
                    at, x = at[use], x[use]
                if len(at):
                    held.setdefault(dim, []).append((ids[at], x))
                    if sum(len(a) for a, _ in held[dim]) >= rows:
                        yield from full(dim, rows)
        for dim in list(held):
            yield from full(dim, 1)

    return run


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []  # start, end, centre, radius, children
        self._split(0, len(ids))

    def _split(self, a: int, b: int) -> int:
        x = self.x[a:b]
        centre = x.mean(0)
        away = np.sqrt(((x - centre) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append((a, b, centre, float(away.max()), -1, -1))
        if b - a > LEAF_ROWS:
            # the two ends of the ball: the point furthest from the centre, and the one furthest from that
            one = x[away.argmax()]
            two = x[((x - one) ** 2).sum(1).argmax()]
            side = x @ (two - one)
            order = np.argsort(side, kind="stable")
            self.x[a:b], self.ids[a:b] = x[order], self.ids[a:b][order]
            left, right = self._split(a, (a + b) // 2), self._split((a + b) // 2, b)
            self.nodes[me] = (*self.nodes[me][:4], left, right)
        return me


class Shard:
    """A shard's rows in the order of its tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.tree = BallTree(np.arange(len(ids)), x[order])
        self.ids, self.x = ids[order][self.tree.ids], x[order][self.tree.ids]
        self.most = float(np.abs(x).max(initial=0))


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products of integers held as doubles, clipped to 64 bits; most: a bound on their absolute values."""
    if most < 2**53:
        return np.rint(q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    big = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in x], object).reshape(x.shape).T
    return np.array([[min(max(int(v), _LEAST + 1), _MOST) for v in row] for row in big], np.int64).reshape(len(q), len(x))


class Search:
    """The k best of a block of queries over the shards it meets; floor: scores that the kth is known to reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.most = float(np.abs(q).max(initial=0))
        self.floor = np.full(len(ids), _LEAST) if floor is None else floor
        # norms of vectors whose squares overflow are infinite, and so are their bounds: such nodes are searched
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.q**2).sum(1))
        self.scores = np.full((len(ids), k), _LEAST)
        self.found = np.full((len(ids), k), _MOST)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def shard(self, shard: Shard) -> None:
        most = self.most * shard.most * shard.x.shape[1]
        nodes, stack = shard.tree.nodes, [(0, np.arange(len(self.ids)))]

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore", invalid="ignore"):
                radius = self.norm[rows] * nodes[node][3]
                far = self.q[rows] @ nodes[node][2] + radius
                far = far + 1e-6 * (1 + self.norm[rows]) + 1e-9 * np.abs(radius) + 1e-9 * np.abs(far)
            return np.where(np.isnan(far), np.inf, far)

        while stack:
            node, rows = stack.pop()
            rows = rows[bound(node, rows) >= self.kth(rows)]
            if not len(rows):
                continue
            a, b, _, _, left, right = nodes[node]
            if left < 0:
                self._leaf(rows, shard.ids[a:b], shard.x[a:b], most)
                continue
            near, far = (left, right) if bound(left, rows).sum() >= bound(right, rows).sum() else (right, left)
            stack += [(far, rows), (near, rows)]

    def _leaf(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, most: float) -> None:
        got = products(self.q[rows], x, most)
        got[self.ids[rows][:, None] == ids[None, :]] = _LEAST
        some = (got >= self.kth(rows)[:, None]).any(1)
        rows, got = rows[some], got[some]
        if len(rows):
            scores = np.concatenate([self.scores[rows], got], 1)
            found = np.concatenate([self.found[rows], np.where(got == _LEAST, _MOST, ids[None, :])], 1)
            best = np.lexsort((found, ~scores), axis=1)[:, : self.k]
            self.scores[rows] = np.take_along_axis(scores, best, 1)
            self.found[rows] = np.take_along_axis(found, best, 1)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["dim"]).astype(np.float64)


def _meet(k: int):
    def run(key, shards: pa.Table, blocks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        held: dict[int, list[Shard]] = {}
        for row in shards.to_pylist():
            held.setdefault(row["dim"], []).append(Shard(*_unpack(row)))
        for block in blocks.to_pylist():
            floor = np.frombuffer(block["floor"], np.int64) if block["floor"] else None
            search = Search(*_unpack(block), k, floor)
            for shard in held.get(block["dim"], []):
                search.shard(shard)
            full = search.found < _MOST
            out["query_id"].append(np.repeat(search.ids, full.sum(1)))
            out["vec_id"].append(search.found[full])
            out["score"].append(search.scores[full])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in out.items()})

    return run


def _floors(k: int):
    """Each block with the kth scores of its queries over the shards of one group."""

    def run(key, shards: pa.Table, blocks: pa.Table) -> pa.Table:
        held: dict[int, list[Shard]] = {}
        for row in shards.to_pylist():
            held.setdefault(row["dim"], []).append(Shard(*_unpack(row)))
        floors = []
        for block in blocks.to_pylist():
            search = Search(*_unpack(block), k)
            for shard in held.get(block["dim"], []):
                search.shard(shard)
            floors.append(search.scores[:, -1].tobytes())
        return blocks.select(["part", "dim", "ids", "vectors", "kind"]).append_column("floor", pa.array(floors, pa.binary()))

    return run


def top_k(vectors: DataFrame, vector: str = "embedding", ids: str = "vec_id", k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """Each query's (rows whose id is divisible by ``every``) k best rows: query_id, rank, vec_id, score."""
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = vectors.where(F.col(ids).isNotNull()).select(F.col(ids).cast("long").alias("id"), F.col(vector).alias("vector"))
    shards = scratch.write(rows.mapInArrow(_blocks(SHARD_ROWS, scale, None), _BLOCK), "shards")
    x = F.col("vector")
    fit = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    own = rows.where((F.col("id") % every == 0) & fit).groupBy("id").agg(F.min(F.struct(F.size(x).alias("n"), x.alias("x"))).getField("x").alias("vector"))
    queries = scratch.write(own, "queries")
    # full blocks, however many partitions the table has
    queries = queries.repartition(max(1, -(-queries.count() // QUERY_ROWS)))
    blocks = scratch.write(queries.mapInArrow(_blocks(QUERY_ROWS, scale, every), _BLOCK), "blocks")
    groups, spans = max(1, -(-shards.count() // GROUP_SHARDS)), max(1, -(-blocks.count() // GROUP_BLOCKS))
    group, span = F.pmod(F.xxhash64("part"), F.lit(groups)), F.pmod(F.xxhash64("part"), F.lit(spans))
    placed = shards.withColumn("grp", group)
    each = F.explode(F.sequence(F.lit(0), F.lit(spans - 1)).cast("array<long>"))
    if groups > 1:
        first = placed.where("grp = 0").withColumn("span", each)
        blocks = first.groupBy("span").cogroup(blocks.withColumn("span", span).groupBy("span")).applyInArrow(_floors(k), f"{_BLOCK}, floor binary")
        blocks = scratch.write(blocks, "floors")
    else:
        blocks = blocks.withColumn("floor", F.lit(None).cast("binary"))
    left = placed.withColumn("span", each)
    right = blocks.withColumn("span", span).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    met = left.groupBy("span", "grp").cogroup(right.groupBy("span", "grp")).applyInArrow(_meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
