"""Sequences (id, i, sym): access, rank, select, enumerate, successor; bit vectors; prefix codes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build(table: DataFrame, ids: str, order: list[str], symbol: str) -> DataFrame:
    """A table as sequences: one per id, in the given order, positions from 0."""
    at = F.row_number().over(Window.partitionBy(ids).orderBy(*order)) - 1
    return table.select(F.col(ids).alias("id"), at.cast("long").alias("i"), F.col(symbol).alias("sym"))


def access(seq: DataFrame, at: list[int]) -> DataFrame:
    return seq.where(F.col("i").isin(at))


def rank(seq: DataFrame, symbol) -> DataFrame:
    """(id, i, rank): how often the symbol occurs up to and with each position."""
    order = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return seq.select("id", "i", F.count(F.when(F.col("sym") == symbol, 1)).over(order).alias("rank"))


def rank_access(seq: DataFrame) -> DataFrame:
    """(id, i, sym, rank): each position's symbol and its rank among equal ones."""
    return seq.select("id", "i", "sym", F.row_number().over(Window.partitionBy("id", "sym").orderBy("i")).cast("long").alias("rank"))


def select(seq: DataFrame, nth: int) -> DataFrame:
    """(id, sym, i): position of each symbol's nth occurrence, from 1; symbols with fewer are absent."""
    return rank_access(seq).where(F.col("rank") == nth).select("id", "sym", "i")


def enumerate_range(seq: DataFrame, low: int, high: int) -> DataFrame:
    """(id, sym, freq) of the symbols in a range of positions."""
    return seq.where(F.col("i").between(low, high)).groupBy("id", "sym").agg(F.count("*").alias("freq"))


def successor(seq: DataFrame, symbol) -> DataFrame:
    """(id, i, succ): the first position from each position on that holds the symbol, null if none does."""
    order = Window.partitionBy("id").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    return seq.select("id", "i", F.min(F.when(F.col("sym") == symbol, F.col("i"))).over(order).alias("succ"))


def bits(seq: DataFrame, symbol) -> DataFrame:
    return seq.select("id", "i", (F.col("sym") == symbol).cast("long").alias("bit"))


def bit_rank(vector: DataFrame) -> DataFrame:
    """(id, i, bit, rank1, rank0), both inclusive."""
    ones = F.sum("bit").over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return vector.select("id", "i", "bit", ones.alias("rank1"), (F.col("i") + 1 - ones).alias("rank0"))


def sparse(vector: DataFrame) -> DataFrame:
    """(id, k, pos): only the ones of a bit vector, numbered from 1."""
    ones = vector.where("bit = 1")
    return ones.select("id", F.row_number().over(Window.partitionBy("id").orderBy("i")).cast("long").alias("k"), F.col("i").alias("pos"))


def sparse_rank(ones: DataFrame, at: list[int], ids: DataFrame) -> DataFrame:
    """(id, i, rank1) at the given positions from the ones alone, for each of the ids; an id without ones has rank 0."""
    cells = [F.count(F.when(F.col("pos") <= i, 1)).alias(f"r{n}") for n, i in enumerate(at)]
    wide = ids.select("id").distinct().join(ones.groupBy("id").agg(*cells), "id", "left")
    return wide.select("id", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.coalesce(f"r{n}", F.lit(0)).alias("rank1")) for n, i in enumerate(at)])))


def check(seq: DataFrame) -> DataFrame:
    """(id, wrong): how many positions disagree between access, rank and select over a whole sequence; 0 if it is sound."""
    # select(rank(i), sym) must lead back to i, and each rank be one more than that of the symbol's place before
    before = Window.partitionBy("id", "sym").orderBy("i")
    ranked = rank_access(seq).withColumn("step", F.col("rank") - F.coalesce(F.lag("rank").over(before), F.lit(0)))
    found = rank_access(seq).toDF("id", "place", "sym", "rank")
    met = ranked.join(found, ["id", "sym", "rank"], "left")
    good = F.coalesce((F.col("place") == F.col("i")) & (F.col("step") == 1), F.lit(False))
    return met.groupBy("id").agg(F.count(F.when(~good, 1)).alias("wrong"))


def code_lengths(freq: list[tuple[str, int]], most: int = 32) -> dict[str, int]:
    """Huffman code lengths; weights are halved until no code is longer than ``most`` bits. A lone symbol has one bit."""
    weights = dict(freq)
    while True:
        heap = [(w, i, [s]) for i, (s, w) in enumerate(sorted(weights.items()))]
        heapq.heapify(heap)
        length = dict.fromkeys(weights, 0 if len(heap) > 1 else 1)
        n = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                length[s] += 1
            heapq.heappush(heap, (a + b, n, x + y))
            n += 1
        if max(length.values(), default=0) <= most:
            return length
        weights = {s: (w + 1) // 2 for s, w in weights.items()}


def huffman(freq: DataFrame) -> DataFrame:
    """(id, sym, freq, clen, code) from (id, sym, freq): canonical prefix codes, as many rows in a task as an alphabet has."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("sym").to_pylist(), table.column("freq").to_pylist()))
        lengths = code_lengths(rows)
        code = last = 0
        out = []
        counts = dict(rows)
        for s in sorted(lengths, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - last
            last = lengths[s]
            out.append((table.column("id")[0].as_py(), s, counts[s], lengths[s], format(code, f"0{lengths[s]}b")))
            code += 1
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["id", "sym", "freq", "clen", "code"])

    return freq.groupBy("id").applyInArrow(run, "id long, sym string, freq long, clen long, code string")
