"""Index construction: suffix arrays, the index table, rank blocks, alphabets, and texts back from their BWT.

The index of a text of n symbols has n + 1 rows ``(id, r, pos, ch, bw, lf, psi)``: r is the rank of the suffix that starts
at pos (row 0 is the empty suffix), ch its first symbol, bw the symbol before it (null at the text's start), lf the row of
the suffix one symbol longer, psi the row of the one shorter (cyclic). Symbols are code points, whose order is that of
UTF-8 bytes.

Rank blocks ``(id, block, bws, before)`` are what backward search needs: the bw column in strings of ``BLOCK`` rows and the
count of each symbol before each block, so the rank of a symbol up to any row takes one row of them.

A packed index is a row a text, for searches alone: its bw column without the end-of-text row, in strings of ``step`` rows,
and the counts before each string. It is made where the text is, without the index table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Longer texts are sorted by joins over all executors instead of in one task.
LOCAL_SYMBOLS = 2_000_000
#: Rows of a rank block.
BLOCK = 256
#: Stands for the end of the text in a block's string (a code point that is no character); the row's symbol is null.
END = "\U0010ffff"
#: Texts are sorted together up to so many symbols: few calls for short texts, tables that stay in a core's cache.
GROUP = 1 << 16
_PACKED = "id long, n long, last long, step int, syms string, starts array<long>, bws array<string>, before array<int>"
_ROWS = "id long, r long, pos long, ch string, bw string, lf long, psi long"


def sort_texts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays of texts in one: starts among all symbols, with an end after each text, sorted by (text, suffix).

    First by as many symbols as fit into 64 bits beside the text's number, then by doubling, for suffixes that still tie
    only. Suffixes of one text end at different places, so they differ at an end at the latest and nothing behind it counts.
    """
    n, bits_of = int(lengths.sum()) + len(lengths), lambda x: max(1, int(x).bit_length())
    found, small = _dense(codes)
    bits, high = bits_of(len(found)), bits_of(len(lengths) - 1)
    width = (64 - high) // bits
    one = np.zeros(n + width, np.uint64)
    within = np.ones(n, bool)
    within[np.cumsum(lengths + 1) - 1] = False
    one[:n][within] = small + 1
    # width symbols in a number, from those of 1, 2, 4, ... symbols
    key, have, power, size = np.zeros(n + width, np.uint64), 0, one, 1
    while True:
        if width & size:
            key <<= np.uint64(bits * size)
            key[: n + width - have] |= power[have:]
            have += size
        if 2 * size > width:
            break
        later, power = power[size:], power << np.uint64(bits * size)
        power[: n + width - size] |= later
        size *= 2
    key = key[:n] | np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths + 1) << np.uint64(bits * width)
    order = np.argsort(key)
    starts, sizes = _runs(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(slots):
        at = order[slots]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key)
        order[slots] = at = at[by]
        starts, sizes = _runs(key[by])
        rank[at] = np.repeat(slots[starts], sizes)
        slots, width = slots[np.repeat(sizes > 1, sizes)], 2 * width
    return order


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.diff(starts, append=len(key))


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The alphabet in order, and each symbol's number in it."""
    if not len(codes) or codes.max() >= 1 << 16:
        return np.unique(codes, return_inverse=True)
    found = np.flatnonzero(np.bincount(codes))
    number = np.zeros(1 << 16, np.int64)
    number[found] = np.arange(len(found))
    return found, number[codes]


def sort_suffixes(codes: np.ndarray) -> np.ndarray:
    """Suffix array with the empty suffix first."""
    return sort_texts(codes, np.array([len(codes)]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(text)
            sa = sort_suffixes(_codes(text))
            isa = np.empty(n + 1, np.int64)
            isa[sa] = np.arange(n + 1)
            lf = np.where(sa > 0, isa[np.maximum(sa - 1, 0)], 0)
            psi = isa[np.where(sa < n, sa + 1, 0)]
            symbols = np.array([*text, None], object)
            ch, bw = symbols[sa], symbols[sa - 1]
            for a in range(0, n + 1, 100_000):
                s = slice(a, a + 100_000)
                rows = len(sa[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * rows, pa.int64()), pa.array(np.arange(n + 1)[s]), pa.array(sa[s]), pa.array(ch[s], pa.string()), pa.array(bw[s], pa.string()), pa.array(lf[s]), pa.array(psi[s])],
                    names=["id", "r", "pos", "ch", "bw", "lf", "psi"],
                )


def windows(docs: DataFrame, width: int, before: int = 0) -> DataFrame:
    """(id, pos, part) for each position from 0 to n: the ``width`` symbols from it on, ``before`` of them to its left, clamped.

    A slice takes time in its own length only; SQL's substring walks from the text's start, which is quadratic in a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a in range(0, len(text) + 1, 50_000):
                    at = range(a, min(a + 50_000, len(text) + 1))
                    parts = [text[max(0, i - before) : max(0, i - before + width)] for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(parts, pa.string())], names=["id", "pos", "part"])

    return docs.select("id", "text").mapInArrow(run, "id long, pos long, part string")


def symbols(docs: DataFrame) -> DataFrame:
    """(id, pos, ch, next) of each position from 0 to n - 1; next is '' at the last."""
    chars = docs.where("text <> ''").select("id", F.filter(F.split("text", ""), lambda c: c != "").alias("ch"))
    both = chars.select("id", "ch", F.concat(F.slice("ch", F.lit(2), F.size("ch")), F.array(F.lit(""))).alias("next"))
    at = both.select("id", F.posexplode(F.arrays_zip("ch", "next")).alias("pos", "cell"))
    return at.select("id", F.col("pos").cast("long"), "cell.ch", "cell.next")


def running(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Rows with the sum of a column over the rows of their id that come before them in order.

    Rows are dealt by ranges of (id, order) and summed within each range; the totals of ranges are summed in turn. So no
    task holds an id, however long.
    """
    ranged = cut(rows.repartitionByRange("id", *order).withColumn("_range", F.spark_partition_id()))
    above = Window.partitionBy("id", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = ranged.groupBy("id", "_range").agg(F.sum(value).alias("_total"))
    base = total.select("id", "_range", F.sum("_total").over(Window.partitionBy("id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    summed = ranged.withColumn("_above", F.sum(value).over(above)).join(base, ["id", "_range"])
    return summed.withColumn(out, F.coalesce("_above", F.lit(0)) + F.coalesce("_base", F.lit(0))).drop("_range", "_above", "_base")


def suffix_array_doubling(docs: DataFrame, width: int = 1) -> DataFrame:
    """(id, r, pos) by prefix doubling over joins: for texts too long for a task. It starts from prefixes of ``width`` symbols.

    A round ranks (rank, rank of the suffix width later): a key's rank is how many suffixes have smaller keys, a running sum
    over ranges of keys. A suffix that is alone with its rank keeps it.
    """
    first = windows(docs, width).groupBy("id", "part").agg(F.count("*").alias("many"))
    ranks = running(first, ["part"], "many", "rk").select("id", "part", "rk", "many")
    now = cut(windows(docs, width).join(ranks, ["id", "part"]).select("id", "pos", "rk", "many"))
    while now.where("many > 1").head(1):
        later = now.select("id", (F.col("pos") - width).alias("pos"), F.col("rk").alias("next"))
        open_ = now.where("many > 1").join(later, ["id", "pos"], "left").select("id", "pos", "rk", F.coalesce("next", F.lit(-1)).alias("next"))
        # within a rank, keys are told apart by what comes later: the new rank is the old one plus the smaller keys of the rank
        keys = open_.groupBy("id", "rk", "next").agg(F.count("*").alias("many"))
        summed = running(keys, ["rk", "next"], "many", "above")
        least = summed.groupBy("id", "rk").agg(F.min("above").alias("start"))
        table = summed.join(least, ["id", "rk"]).select("id", "rk", "next", "many", (F.col("rk") + F.col("above") - F.col("start")).alias("r"))
        done = now.where("many = 1").select("id", "pos", "rk", "many")
        now = cut(done.unionByName(open_.join(table, ["id", "rk", "next"]).select("id", "pos", F.col("r").alias("rk"), "many")))
        width *= 2
    return now.select("id", F.col("rk").alias("r"), "pos")


def suffix_array(docs: DataFrame) -> DataFrame:
    """(id, r, pos) by sorting prefixes of sixteen symbols, ties by doubling."""
    return suffix_array_doubling(docs, 16)


def finish(sa: DataFrame, docs: DataFrame) -> DataFrame:
    """The index table of a suffix array made by joins: neighbours in the text by position, without a window over a text."""
    sa = cut(sa.select("id", "r", "pos"))
    cells = symbols(docs)
    length = docs.select("id", F.length("text").cast("long").alias("n"))
    left = sa.select("id", (F.col("pos") + 1).alias("pos"), F.col("r").alias("lf"))
    right = sa.join(length, "id").select("id", F.when(F.col("pos") == 0, F.col("n")).otherwise(F.col("pos") - 1).alias("pos"), F.col("r").alias("psi"))
    here = cells.select("id", "pos", "ch")
    before = cells.select("id", (F.col("pos") + 1).alias("pos"), F.col("ch").alias("bw"))
    out = sa.join(here, ["id", "pos"], "left").join(before, ["id", "pos"], "left").join(left, ["id", "pos"], "left").join(right, ["id", "pos"])
    return out.select("id", "r", "pos", "ch", "bw", F.coalesce("lf", F.lit(0)).alias("lf"), "psi")


def build_index(docs: DataFrame) -> DataFrame:
    """The index table of each text: one task sorts a text, without a shuffle."""
    return docs.select("id", "text").mapInArrow(_index, _ROWS)


def _packed(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    lengths = np.array([*map(len, texts)])
    codes = _codes("".join(texts))
    sa = sort_texts(codes, lengths)
    which = np.repeat(np.arange(len(texts)), lengths + 1)
    first = np.cumsum(lengths + 1) - lengths - 1
    ends = sa == first[which]
    last = np.flatnonzero(ends) - first
    bw = codes[(sa - 1 - which)[~ends]]
    found, small = _dense(bw)
    steps, syms, starts, cuts, before = [], [], [], [], []
    for a, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist()):
        here = small[a : a + n]
        many = np.bincount(here, minlength=len(found))
        own = np.flatnonzero(many)
        step = max(BLOCK, 4 * len(own))  # a count for each fourth symbol at most, whatever the alphabet
        blocks = n // step + 1
        counts = np.bincount(np.arange(n) // step * len(found) + here, minlength=blocks * len(found)).reshape(blocks, len(found))[:, own]
        steps.append(step)
        syms.append(found[own].astype("<u4").tobytes().decode("utf-32-le"))
        starts.append(1 + np.cumsum(many[own]) - many[own])
        cuts.append(np.arange(a, a + n + 1, step))
        before.append((np.cumsum(counts, 0) - counts).ravel())
    at = np.concatenate([[0], np.cumsum(1 + (bw > 0x7F) + (bw > 0x7FF) + (bw > 0xFFFF))])
    ends_of = lambda parts: pa.array(np.concatenate([[0], np.cumsum([*map(len, parts)])]), pa.int32())
    strings = np.append(at[np.concatenate(cuts)], at[-1]).astype(np.int32)
    bws = pa.StringArray.from_buffers(len(strings) - 1, pa.py_buffer(strings), pa.py_buffer(bw.tobytes().decode("utf-32-le").encode()))
    lists = [pa.ListArray.from_arrays(ends_of(p), v) for p, v in ((starts, pa.array(np.concatenate(starts), pa.int64())), (cuts, bws), (before, pa.array(np.concatenate(before), pa.int32())))]
    columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(last, pa.int64()), pa.array(steps, pa.int32()), pa.array(syms, pa.string()), *lists]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n", "last", "step", "syms", "starts", "bws", "before"])


def pack_index(docs: DataFrame) -> DataFrame:
    """(id, n, last, step, syms, starts, bws, before), a row a text: one task sorts a text, without a shuffle.

    last is the end-of-text row, which bws leave out; syms are the symbols in order and starts their first rows; before has
    the counts of all syms before each string of bws, string after string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text) > GROUP:
                    yield _packed(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(one)
                texts.append(text)
                size += len(text) + 1
            if texts:
                yield _packed(ids, texts)

    return docs.select("id", "text").mapInArrow(run, _PACKED)


def build_index_any(docs: DataFrame) -> DataFrame:
    """As build_index, with texts over LOCAL_SYMBOLS sorted across executors."""
    long = docs.where(F.length("text") > LOCAL_SYMBOLS)
    short = build_index(docs.where(F.length("text") <= LOCAL_SYMBOLS))
    return short.unionByName(finish(suffix_array_doubling(long, 16), long)) if long.head(1) else short


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, syms, freqs = [], [], []
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = _codes(text)
            if not len(codes):
                continue
            if codes.max() < 1 << 16:
                count = np.bincount(codes)
                found = np.flatnonzero(count)
                count = count[found]
            else:
                found, count = np.unique(codes, return_counts=True)
            ids += [one] * len(found)
            syms += map(chr, found.tolist())
            freqs += count.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(syms, pa.string()), pa.array(freqs, pa.int64())], names=["id", "sym", "freq"])


def symbol_freq(docs: DataFrame) -> DataFrame:
    """(id, sym, freq), counted where each text is: one pass, no row for a symbol's every occurrence and no shuffle."""
    return docs.select("id", "text").mapInArrow(_counts, "id long, sym string, freq long")


def alphabet(docs: DataFrame) -> DataFrame:
    """(id, sym, code, freq, k_start): codes by ascending symbol; k_start is the first row whose suffix starts with sym."""
    order = Window.partitionBy("id").orderBy("sym")  # as many rows as a text has distinct symbols
    freq = symbol_freq(docs)
    return freq.select("id", "sym", (F.row_number().over(order) - 1).cast("long").alias("code"), "freq", (1 + F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("freq")).alias("k_start"))


def rank_directory(index: DataFrame, block: int) -> DataFrame:
    """(id, block, sym, before, here): how often each symbol occurs in bw before each block of rows, and in it."""
    cell = index.where("bw is not null").select("id", F.floor(F.col("r") / block).alias("block"), F.col("bw").alias("sym"))
    sums = cell.groupBy("id", "sym", "block").agg(F.count("*").alias("here"))
    order = Window.partitionBy("id", "sym").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("id", "block", "sym", (F.sum("here").over(order) - F.col("here")).alias("before"), "here")


def rank_blocks(index: DataFrame) -> DataFrame:
    """(id, block, bws, before): bw in strings of ``BLOCK`` rows, and each symbol's count before the block."""
    block = F.floor(F.col("r") / BLOCK).alias("block")
    cells = F.array_sort(F.collect_list(F.struct("r", F.coalesce("bw", F.lit(END)).alias("bw"))))
    strings = index.groupBy("id", block).agg(F.array_join(F.transform(cells, lambda x: x["bw"]), "").alias("bws"))
    here = rank_directory(index, BLOCK)
    # a symbol's count before a block is that of the next block at or before which has it, so it is told to every block after
    last = strings.groupBy("id").agg(F.max("block").alias("last"))
    following = Window.partitionBy("id", "sym").orderBy("block")
    spread = here.select("id", "sym", "block", (F.col("before") + F.col("here")).alias("after"), F.lead("block").over(following).alias("next")).join(last, "id")
    upto = F.least(F.coalesce("next", "last"), "last")
    told = spread.where(F.col("block") < upto).select("id", "sym", "after", F.explode(F.sequence(F.col("block") + 1, upto)).alias("block"))
    maps = told.groupBy("id", "block").agg(F.map_from_entries(F.collect_list(F.struct("sym", "after"))).alias("before"))
    return strings.join(maps, ["id", "block"], "left").select("id", "block", "bws", F.coalesce("before", F.create_map().cast("map<string,long>")).alias("before"))


def heads(index: DataFrame) -> DataFrame:
    """(id, n, starts, counts): a text's length, the first row of each of its symbols, and how often each occurs."""
    first = index.where("ch is not null").groupBy("id", "ch").agg(F.min("r").alias("start"), F.count("*").alias("many"))
    maps = first.groupBy("id").agg(*[F.map_from_entries(F.collect_list(F.struct("ch", c))).alias(n) for c, n in (("start", "starts"), ("many", "counts"))])
    length = index.groupBy("id").agg((F.count("*") - 1).alias("n"))
    none = F.create_map().cast("map<string,long>")
    return length.join(maps, "id", "left").select("id", "n", F.coalesce("starts", none).alias("starts"), F.coalesce("counts", none).alias("counts"))


def rank_in(bws: Column, before: Column, row: Column, symbol: Column) -> Column:
    """How often a symbol occurs in bw up to and with a row, from the row's block; 0 where the block is missing (row -1)."""
    part = F.substring(bws, F.lit(1), (F.pmod(row, F.lit(BLOCK)) + 1).cast("int"))
    return F.coalesce(F.element_at(before, symbol), F.lit(0)) + F.coalesce(F.length(part) - F.length(F.replace(part, symbol, F.lit(""))), F.lit(0))


def bw_ranked(index: DataFrame) -> DataFrame:
    """bw with its inclusive rank among equal symbols: the count before the row's block and a count within it."""
    block = F.floor(F.col("r") / BLOCK)
    here = Window.partitionBy("id", "bw", "block").orderBy("r")
    rows = index.where("bw is not null").select("id", "r", "bw", block.alias("block"))
    base = rank_directory(index, BLOCK).select("id", F.col("sym").alias("bw"), "block", "before")
    return rows.withColumn("k", F.row_number().over(here)).join(base, ["id", "bw", "block"]).select("id", "r", "bw", (F.col("before") + F.col("k")).alias("bw_rank"))


def lf_from_bwt(bwt: DataFrame) -> DataFrame:
    """(id, r, bw, lf) from (id, r, bw) alone: the symbol's first row plus its rank; the end-of-text row leads to row 0."""
    ranked = bw_ranked(bwt)
    freq = ranked.groupBy("id", "bw").agg(F.count("*").alias("freq"))
    start = freq.select("id", "bw", (1 + F.sum("freq").over(Window.partitionBy("id").orderBy("bw").rowsBetween(Window.unboundedPreceding, 0)) - F.col("freq")).alias("start"))
    known = ranked.join(start, ["id", "bw"]).select("id", "r", "bw", (F.col("start") + F.col("bw_rank") - 1).alias("lf"))
    return known.unionByName(bwt.where("bw is null").select("id", "r", "bw", F.lit(0).cast("long").alias("lf")))


def inverse_bwt(bwt: DataFrame) -> DataFrame:
    """(id, text) from (id, r, bw) by pointer doubling: log2(n) joins instead of n steps.

    The row reached from row 0 after s steps holds the s-th symbol from the end. Each round doubles both the rows of which
    the distance to the end-of-text row is known and the length of a jump.
    """
    lf = lf_from_bwt(bwt)
    ends = lf.where("bw is null").select("id", F.col("r").alias("last"))
    # distance of each row to the row before the text's start, walking by lf
    now = cut(lf.join(ends, "id").select("id", "r", "last", F.col("lf").alias("to"), F.when(F.col("r") == F.col("last"), 0).otherwise(1).cast("long").alias("dist"), (F.col("r") == F.col("last")).alias("done")))
    while now.where("not done").head(1):
        via = now.select("id", F.col("r").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        joined = now.join(via, ["id", "to"])
        now = cut(
            joined.select("id", "r", "last", F.when(F.col("done"), F.col("to")).otherwise(F.col("to2")).alias("to"), F.when(F.col("done"), F.col("dist")).otherwise(F.col("dist") + F.col("dist2")).alias("dist"), (F.col("done") | F.col("done2")).alias("done"))
        )
    # a row at distance d stands before position d, so its bw is symbol d - 1
    cells = now.join(lf.select("id", "r", "bw"), ["id", "r"])
    return cells.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bw").isNotNull(), F.struct(F.col("dist").alias("d"), F.col("bw").alias("c"))))), lambda x: x["c"]), "").alias("text"))


def unbwt(index: DataFrame) -> DataFrame:
    """(id, text): the symbols of an index by position."""
    cells = F.collect_list(F.when(F.col("ch").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("ch").alias("c"))))
    return index.groupBy("id").agg(F.array_join(F.transform(F.array_sort(cells), lambda x: x["c"]), "").alias("text"))


def sizes(index: DataFrame) -> DataFrame:
    """(id, n_rows, bw_bytes, index_bytes): rows of each index, bytes of its bw column alone, and of all its columns uncompressed."""
    bw = F.coalesce(F.octet_length("bw"), F.lit(0))
    return index.groupBy("id").agg(
        F.count("*").alias("n_rows"), F.sum(bw).cast("long").alias("bw_bytes"), F.sum(bw + F.coalesce(F.octet_length("ch"), F.lit(0)) + 40).cast("long").alias("index_bytes")
    )


def check(index: DataFrame) -> DataFrame:
    """(id, wrong): how many rows break one of lf(psi(r)) = r, pos(psi(r)) = pos + 1, ch(r) = bw(psi(r)); 0 for a sound index."""
    via = index.select("id", F.col("r").alias("psi"), F.col("lf").alias("back"), F.col("pos").alias("later"), F.col("bw").alias("here"))
    met = index.join(via, ["id", "psi"], "left")
    good = F.coalesce((F.col("back") == F.col("r")) & (F.col("later") == F.when(F.col("ch").isNull(), 0).otherwise(F.col("pos") + 1)) & F.col("ch").eqNullSafe(F.col("here")), F.lit(False))
    return met.groupBy("id").agg(F.count(F.when(~good, 1)).alias("wrong"))
