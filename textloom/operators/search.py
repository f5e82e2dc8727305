"""Exact search: backward search over rank blocks, one-symbol extensions, counting and locating without an index, extraction.

Backward search takes a pattern from its last symbol to its first. A step turns the range of the symbols read so far into
that of one symbol more by two ranks and the symbol's first row, so it needs two rows of the rank blocks whatever the
text's length. Nothing here holds suffix strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import BLOCK, heads, rank_blocks, rank_in

WHITE = "[ \\t\\n\\r\\f\\x0B]"


@dataclass(frozen=True)
class Ranks:
    """Rank blocks and heads of an index: made once, or loaded, and used by many searches."""

    blocks: DataFrame
    heads: DataFrame


def ranks(index: DataFrame) -> Ranks:
    return Ranks(rank_blocks(index), heads(index))


def literals(patterns: list[str]) -> Column:
    return F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")


def in_text(rows: DataFrame, docs: DataFrame, make: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """The rows with what ``make`` (of text and row) gives: a text meets the rows of its id as one array and isn't copied for each."""
    names = [c for c in rows.columns if c != "id"]
    held = rows.groupBy("id").agg(F.collect_list(F.struct(*names)).alias("_rows")).join(docs.select("id", "text"), "id")
    return held.select("id", F.inline(F.transform("_rows", lambda x: F.struct(*[x[c].alias(c) for c in names], *[e.alias(n) for n, e in make(F.col("text"), x).items()]))))


def _with_blocks(nodes: DataFrame, known: Ranks) -> DataFrame:
    """Nodes with the blocks of the row before their range (lows, low_before) and of its last row (highs, high_before), and starts."""
    low = known.blocks.select("id", F.col("block").alias("_low"), F.col("bws").alias("_lows"), F.col("before").alias("_low_before"))
    high = known.blocks.select("id", F.col("block").alias("_high"), F.col("bws").alias("_highs"), F.col("before").alias("_high_before"))
    placed = nodes.withColumn("_low", F.floor((F.col("l") - 1) / BLOCK)).withColumn("_high", F.floor(F.col("r") / BLOCK))
    met = placed.join(low, ["id", "_low"], "left").join(high, ["id", "_high"], "left")
    return met if "starts" in nodes.columns else met.join(known.heads.select("id", "starts"), "id")


def _extended(symbol: Column) -> tuple[Column, Column]:
    """First and last row of a range of ``_with_blocks`` after a symbol is put before it; empty if the first is greater."""
    start = F.element_at("starts", symbol)
    low = start + rank_in(F.col("_lows"), F.col("_low_before"), F.col("l") - 1, symbol)
    return low, start + rank_in(F.col("_highs"), F.col("_high_before"), F.col("r"), symbol) - 1


def search_range(index: DataFrame | None, docs: DataFrame | None, patterns: list[str], known: Ranks | None = None) -> DataFrame:
    """(id, pattern, l, r) of the rows whose suffixes start with each pattern that occurs. The empty pattern has all rows.

    The texts aren't read: ``docs`` may be None, and the index too if its ranks are known.
    """
    known = known or ranks(index)
    # the last symbol's rows are known without a rank
    last = F.substring("pattern", F.length("pattern"), F.lit(1))
    rows = known.heads.select("id", "n", "starts", "counts", F.explode(literals(patterns)).alias("pattern"))
    low, high = F.element_at("starts", last), F.element_at("starts", last) + F.element_at("counts", last) - 1
    empty = F.length("pattern") == 0
    now = rows.select("id", "pattern", "starts", F.when(empty, 0).otherwise(low).cast("long").alias("l"), F.when(empty, F.col("n")).otherwise(high).alias("r")).where("l <= r")
    for step in range(1, max(map(len, patterns), default=0)):
        low, high = _extended(F.substring("pattern", F.greatest(F.length("pattern") - step, F.lit(1)), F.lit(1)))
        ready = F.length("pattern") <= step  # read to its first symbol
        moved = _with_blocks(now, known).select("id", "pattern", "starts", F.when(ready, F.col("l")).otherwise(low).alias("l"), F.when(ready, F.col("r")).otherwise(high).alias("r"))
        now = moved.where("l <= r")
    return now.drop("starts")


def search_packed(packed: DataFrame, patterns: list[str]) -> DataFrame:
    """As search_range, on a packed index: the steps of all patterns are expressions over a text's row, without a join or shuffle."""

    def rank(symbol: Column, row: Column) -> Column:
        size = row + F.when(row < F.col("last"), 1).otherwise(0)  # symbols of bws up to and with the row
        block, code = F.floor(size / F.col("step")), F.position(symbol, "syms")
        part = F.substring(F.get("bws", block.cast("int")), F.lit(1), F.pmod(size, "step").cast("int"))
        return F.get("before", (block * F.length("syms") + code - 1).cast("int")) + F.length(part) - F.length(F.replace(part, symbol, F.lit("")))

    def step(now: Column, symbol: Column) -> Column:
        code = F.position(symbol, "syms")
        start = F.get("starts", code - 1)
        ends = F.struct((start + rank(symbol, now["l"] - 1)).alias("l"), (start + rank(symbol, now["r"]) - 1).alias("r"))
        return F.when((code == 0) | (now["l"] > now["r"]), none).otherwise(ends)

    none = F.struct(F.lit(1).cast("long").alias("l"), F.lit(0).cast("long").alias("r"))
    every = F.struct(F.lit(0).cast("long").alias("l"), F.col("n").alias("r"))
    asked = [F.struct(F.lit(p).alias("pattern"), literals([*reversed(p)]).alias("back")) for p in patterns]
    if not asked:
        return packed.select("id", F.lit("").alias("pattern"), F.col("n").alias("l"), F.col("n").alias("r")).where("false")
    found = F.transform(F.array(*asked), lambda x: F.struct(x["pattern"].alias("pattern"), F.aggregate(x["back"], every, step).alias("at")))
    return packed.select("id", F.inline(found)).select("id", "pattern", "at.l", "at.r").where("l <= r")


def max_match(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, pattern, matched): length of the longest suffix of the pattern that occurs (backward search stops there)."""
    rows = docs.select("id", "text", F.explode(literals(patterns)).alias("pattern"))
    lengths = F.filter(F.sequence(F.lit(0), F.length("pattern")), lambda k: F.contains(F.col("text"), F.substring(F.col("pattern"), F.length("pattern") - k + 1, k)))
    return rows.select("id", "pattern", F.array_max(lengths).cast("long").alias("matched"))


def rows_of(nodes: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes with each index row of their range (row, and the columns asked for), met by blocks of rows."""
    named = nodes.withColumn("_block", F.explode(F.sequence(F.floor(F.col("l") / BLOCK), F.floor(F.col("r") / BLOCK))))
    rows = index.select(F.col("id"), F.floor(F.col("r") / BLOCK).alias("_block"), F.col("r").alias("row"), *columns)
    return named.join(rows, ["id", "_block"]).where(F.col("row").between(F.col("l"), F.col("r"))).drop("_block")


def search_left(nodes: DataFrame, index: DataFrame, symbol: str | None = None, known: Ranks | None = None) -> DataFrame:
    """Ranges after prepending a symbol (all symbols if none is given): (id, key, sym, l, r), without the sentinel."""
    met = _with_blocks(nodes, known or ranks(index))
    which = F.map_keys("starts") if symbol is None else F.array(F.lit(symbol))
    each = met.withColumn("sym", F.explode(which))
    low, high = _extended(F.col("sym"))
    return each.select("id", "key", "sym", low.alias("l"), high.alias("r")).where("l <= r")


def search_right(nodes: DataFrame, index: DataFrame, docs: DataFrame | None = None, symbol: str | None = None) -> DataFrame:
    """Ranges after appending a symbol (all symbols if none is given): (id, key, sym, l, r), without the sentinel; docs isn't read."""
    later = index.where("ch is not null" if symbol is None else F.col("ch") == symbol).select("id", F.col("pos").alias("at"), F.col("ch").alias("sym"))
    hit = rows_of(nodes, index, ["pos"]).select("id", "key", "row", (F.col("pos") + F.col("depth")).alias("at"))
    return hit.join(later, ["id", "at"]).groupBy("id", "key", "sym").agg(F.min("row").alias("l"), F.max("row").alias("r"))


def child(nodes: DataFrame, index: DataFrame, left: bool, known: Ranks | None = None) -> DataFrame:
    """All ranges one symbol to the left or to the right: (id, key, sym, l, r)."""
    return search_left(nodes, index, known=known) if left else search_right(nodes, index)


def nodes(index: DataFrame, docs: DataFrame | None, keys: list[str], known: Ranks | None = None) -> DataFrame:
    """(id, key, depth, l, r) of the keys that occur; docs isn't read."""
    return search_range(index, docs, keys, known).select("id", F.col("pattern").alias("key"), F.length("pattern").cast("long").alias("depth"), "l", "r")


def _quoted(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def occurrences(text: Column, pattern: str) -> Column:
    """Overlapping occurrences of a pattern, as a column expression; n + 1 for the empty pattern."""
    if not pattern:
        return (F.length(text) + 1).cast("long")
    return F.size(F.regexp_extract_all(text, F.lit(f"(?=({_quoted(pattern)}))"), F.lit(1))).cast("long")


def count_patterns(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, pattern, occ) for every text and pattern: one scan, no shuffle, nothing but built-in functions."""
    cells = F.array(*[F.struct(F.lit(p).alias("pattern"), occurrences(F.col("text"), p).alias("occ")) for p in patterns])
    return docs.select("id", F.inline(cells))


def _found(text: str, pattern: str) -> Iterator[int]:
    i = text.find(pattern)
    while i >= 0:
        yield i
        i = text.find(pattern, i + 1) if i < len(text) else -1


def contexts(docs: DataFrame, patterns: list[str], left: int, right: int, flat: bool = False, past: int | None = None) -> DataFrame:
    """(id, pattern, pos, context): from ``left`` symbols before to ``right`` symbols from each hit, clamped to the text.

    With ``past``, to so many symbols past the pattern's end. Built-in functions would need a position-by-position filter,
    quadratic on non-ASCII text, or a shuffle; a scan with ``str.find`` is linear, stays where the text is, and hands its
    rows on by the ten thousand.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["id", "pattern", "pos", "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            rows: list[tuple] = []
            for who, text in zip(one.column(0).to_pylist(), one.column(1).to_pylist()):
                for p in patterns:
                    end = right if past is None else len(p) + past
                    for i in _found(text, p):
                        rows.append((who, p, i, text[max(0, i - left) : i + end]))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
            yield batch(rows)

    out = docs.select("id", "text").mapInArrow(run, "id long, pattern string, pos long, context string")
    return out.withColumn("context", F.regexp_replace("context", WHITE, " ")) if flat else out


def locate_patterns(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, pattern, pos) of all overlapping occurrences; as ``contexts``."""
    return contexts(docs, patterns, 0, 0).select("id", "pattern", "pos")


def proximity(docs: DataFrame, one: str, two: str, within: int) -> DataFrame:
    """(id, pos1, pos2) of hits at most ``within`` symbols apart.

    Hits fall into stretches of the window's length; each second hit is put into the stretches around it, so the join is an
    equi-join and no text pairs all its hits.
    """
    hits = locate_patterns(docs, [one, two])
    width = max(1, within)
    a = hits.where(F.col("pattern") == one).select("id", F.col("pos").alias("pos1"), F.floor(F.col("pos") / width).alias("at"))
    b = hits.where(F.col("pattern") == two).select("id", F.col("pos").alias("pos2"), F.explode(F.sequence(F.floor(F.col("pos") / width) - 1, F.floor(F.col("pos") / width) + 1)).alias("at"))
    return a.join(b, ["id", "at"]).where(F.abs(F.col("pos1") - F.col("pos2")) <= within).select("id", "pos1", "pos2")


def first_hits(index: DataFrame, docs: DataFrame, patterns: list[str], hits: int, width: int, known: Ranks | None = None) -> DataFrame:
    """The first hits in suffix order, each with its right context, white space flattened."""
    found = search_range(index, docs, patterns, known)
    rows = found.select("id", "pattern", F.explode(F.sequence(F.col("l"), F.least(F.col("r"), F.col("l") + hits - 1))).alias("r"), "l")
    placed = rows.select("id", "pattern", (F.col("r") - F.col("l") + 1).alias("k"), "r").join(index.select("id", "r", "pos"), ["id", "r"])
    return in_text(
        placed.select("id", "pattern", "k", "r", "pos"), docs, lambda text, x: {"context": F.regexp_replace(F.substring(text, (x["pos"] + 1).cast("int"), F.lit(width)), WHITE, " ")}
    )

