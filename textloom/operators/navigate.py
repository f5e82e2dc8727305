"""Point navigation on an index, extraction from texts, and a cursor over a text: functions with the arguments of a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import BLOCK, rank_in, windows
from .search import Ranks, ranks


def lookup(index: DataFrame, rows: list[int]) -> DataFrame:
    """(id, r, pos) of the given rows; a row that a text doesn't have is absent."""
    return index.where(F.col("r").isin(rows)).select("id", "r", "pos")


def inverse(index: DataFrame, positions: list[int]) -> DataFrame:
    """(id, pos, r) of the given positions; a position that a text doesn't have is absent."""
    return index.where(F.col("pos").isin(positions)).select("id", "pos", "r")


def sample(index: DataFrame, every: int, column: str = "r") -> DataFrame:
    """(id, r, pos) of each row (or position, by the column) that is a multiple of a number: what a compressed index stores."""
    return index.where(F.col(column) % every == 0).select("id", "r", "pos")


def psi_succ(index: DataFrame, low: int, high: int, least: int) -> DataFrame:
    """(id, row_found): the first row from low to high with psi of at least a number; texts without one are absent."""
    return index.where(F.col("r").between(low, high) & (F.col("psi") >= least)).groupBy("id").agg(F.min("r").alias("row_found"))


def psi_pred(index: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """(id, row_found): the last row from low to high with psi of at most a number; texts without one are absent."""
    return index.where(F.col("r").between(low, high) & (F.col("psi") <= most)).groupBy("id").agg(F.max("r").alias("row_found"))


def rankc(index: DataFrame, symbol: str) -> DataFrame:
    """(id, r, occ): how often a symbol occurs in bw up to and with each row: sums of blocks, and counts within a block."""
    block = index.select("id", "r", F.floor(F.col("r") / BLOCK).alias("block"), F.when(F.col("bw") == symbol, 1).otherwise(0).alias("is"))
    total = block.groupBy("id", "block").agg(F.sum("is").alias("here"))
    base = total.select("id", "block", F.sum("here").over(Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("base"))
    within = F.sum("is").over(Window.partitionBy("id", "block").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return block.withColumn("within", within).join(base, ["id", "block"]).select("id", "r", (F.coalesce("base", F.lit(0)) + F.col("within")).alias("occ"))


def rank_at(index: DataFrame, points: list[tuple[int, str]], known: Ranks | None = None) -> DataFrame:
    """(id, r, sym, occ) at points of (row, symbol): one row of the rank blocks each; -1 and less count nothing."""
    known = known or ranks(index)
    cells = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(c).alias("sym")) for r, c in points])
    each = known.heads.select("id", "n", F.inline(cells)).where("r <= n").withColumn("block", F.floor(F.col("r") / BLOCK))
    return each.join(known.blocks, ["id", "block"], "left").select("id", "r", "sym", rank_in(F.col("bws"), F.col("before"), F.col("r"), F.col("sym")).alias("occ"))


def selectc(ranked: DataFrame, nth: int) -> DataFrame:
    """(id, bw, r): row of each symbol's nth occurrence in bw, from ``index.bw_ranked``; symbols with fewer are absent."""
    return ranked.where(F.col("bw_rank") == nth).select("id", "bw", "r")


def text_range(docs: DataFrame, first: int, last: int) -> DataFrame:
    """(id, part): symbols first to last, inclusive, clamped to the text; empty beyond it."""
    low = max(0, first)
    return docs.select("id", F.substring("text", low + 1, max(0, last - low + 1)).alias("part"))


def extract(docs: DataFrame, first: int, last: int) -> DataFrame:
    """As ``text_range``, for the texts that reach the first position only."""
    return text_range(docs.where(F.length("text") > first), first, last)


def substring_rank(index: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, r, part): the first ``width`` symbols of each row's suffix."""
    return index.select("id", "r", "pos").join(windows(docs, width), ["id", "pos"]).select("id", "r", "part")


def left_context(index: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, r, part): up to ``width`` symbols before each row's suffix."""
    return index.select("id", "r", "pos").join(windows(docs, width, width), ["id", "pos"]).select("id", "r", "part")


class Cursor:
    """A position in every text of an index, from which symbols are read forwards or backwards.

    Reads give (id, pos, ch, r) forwards and (id, pos, bw, r) backwards: the row of each position read, and its symbol or the
    one before it. A read moves the position by as many symbols; a peek doesn't. Beyond a text's ends nothing is read.
    """

    def __init__(self, index: DataFrame, pos: int = 0):
        self.index, self.pos = index, pos

    def seek(self, pos: int) -> Cursor:
        self.pos = pos
        return self

    def here(self) -> DataFrame:
        """(id, pos, r): the row of the position."""
        return self.index.where(F.col("pos") == self.pos).select("id", "pos", "r")

    def peek(self, k: int = 1) -> DataFrame:
        return self.index.where(F.col("pos").between(self.pos, self.pos + k - 1) & F.col("ch").isNotNull()).select("id", "pos", "ch", "r")

    def peek_back(self, k: int = 1) -> DataFrame:
        return self.index.where(F.col("pos").between(self.pos - k + 1, self.pos) & F.col("bw").isNotNull()).select("id", "pos", "bw", "r")

    def read(self, k: int = 1) -> DataFrame:
        out = self.peek(k)
        self.pos += k
        return out

    def read_back(self, k: int = 1) -> DataFrame:
        out = self.peek_back(k)
        self.pos = max(0, self.pos - k)
        return out
