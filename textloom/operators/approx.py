"""Approximate search by edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import windows
from .search import literals


def _ranged(near: DataFrame, index: DataFrame, errors: int) -> DataFrame:
    """Ranges of the beginnings of windows (id, query, pos, part) within the errors of their query."""
    least, most = F.greatest(F.lit(1), F.length("query") - errors), F.least(F.length("part"), F.length("query") + errors)
    spans = near.where(least <= most).select("id", "query", "pos", F.explode(F.transform(F.sequence(least, most), lambda k: F.substring("part", F.lit(1), k))).alias("s"))
    hits = spans.withColumn("error", F.levenshtein("s", "query", errors)).where("error >= 0").join(index.select("id", "pos", "r"), ["id", "pos"])
    found = hits.groupBy("id", "query", "s").agg(F.min("error").cast("long").alias("error"), F.min("r").alias("l"), F.max("r").alias("r"))
    return found.select("id", "query", "error", F.length("s").cast("long").alias("len"), "l", "r")


def search(index: DataFrame, docs: DataFrame, queries: list[str], errors: int) -> DataFrame:
    """(id, query, error, len, l, r) of all distinct substrings within that many edits; the empty one isn't among them."""
    width = max(map(len, queries), default=0) + errors
    return _ranged(windows(docs, width).select("id", "pos", "part", F.explode(literals(queries)).alias("query")), index, errors)


def search_seeded(index: DataFrame, docs: DataFrame, queries: list[str], errors: int) -> DataFrame:
    """The same by seeds: of errors + 1 pieces of the query one occurs exactly, so only what begins around a located piece is verified.

    A query that is too short for its pieces is compared everywhere.
    """
    plain = [q for q in queries if len(q) <= errors]
    split = {}
    for query in queries:
        if len(query) > errors:
            size = len(query) // (errors + 1)
            starts = [i * size for i in range(errors + 1)]
            split[query] = [(s, query[s : (s + size if i < errors else len(query))]) for i, s in enumerate(starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for query, pieces in split.items():
                    begins: set[int] = set()
                    for s, piece in pieces:
                        i = text.find(piece)
                        while i >= 0:
                            begins.update(range(max(0, i - s - errors), i - s + errors + 1))
                            i = text.find(piece, i + 1)
                    at = sorted(begins)
                    for a in range(0, len(at), 10_000):
                        some = at[a : a + 10_000]
                        cols = ([one] * len(some), [query] * len(some), some, [text[i : i + len(query) + errors] for i in some])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "query", "pos", "part"])

    near = docs.select("id", "text").mapInArrow(run, "id long, query string, pos long, part string")
    found = _ranged(near, index, errors)
    return found.unionByName(search(index, docs, plain, errors)) if plain else found


def local_minima(hits: DataFrame, index: DataFrame, errors: int) -> DataFrame:
    """Hits without a better one near by.

    Of equal ranges the least error stays (then the shorter), of ranges that start at the same row the largest. From a
    range's first row the walk goes to the left, then to the right, a row at a time, over at most ``errors`` + 1 rows (its
    own included) and as long as rows start ranges; a smaller error on the way drops the hit.
    """
    same = Window.partitionBy("id", "query", "l", "r").orderBy("error", "len")
    one = hits.withColumn("n", F.row_number().over(same)).where("n = 1")
    start = Window.partitionBy("id", "query", "l").orderBy(F.desc("r"))
    heads = one.withColumn("n", F.row_number().over(start)).where("n = 1").drop("n")
    placed = heads.join(index.select("id", F.col("r").alias("l"), "pos"), ["id", "l"])
    by_pos = placed.select("id", "query", "pos", F.col("error").alias("e"))
    walked = one.drop("n").join(index.select("id", F.col("r").alias("l"), "pos"), ["id", "l"])
    steps = F.explode(F.array(*[F.lit(j) for j in range(-errors, errors + 1)]))
    around = walked.select("id", "query", "l", "r", "error", "len", "pos", steps.alias("j"))
    met = around.join(by_pos.withColumnRenamed("pos", "at"), (F.col("at") == F.col("pos") + F.col("j")) & (around["id"] == by_pos["id"]) & (around["query"] == by_pos["query"]), "left")
    met = met.select(around["id"], around["query"], "l", "r", "error", "len", "j", "e")
    cells = met.groupBy("id", "query", "l", "r", "error", "len").agg(F.map_from_entries(F.collect_list(F.struct("j", "e"))).alias("es"))

    def reached(sign: int) -> F.Column:
        out = F.lit(False)
        for j in range(errors, -1, -1):
            here = F.element_at("es", F.lit(sign * j))
            out = F.when(here.isNull(), F.lit(False)).when(here < F.col("error"), F.lit(True)).otherwise(out)
        return out

    return cells.where(~(reached(-1) | reached(1))).select("id", "query", "error", "len", "l", "r")


def first_row(query: str) -> Column:
    """The row of distances before any symbol: to each beginning of the query."""
    return F.sequence(F.lit(0), F.lit(len(query)))


def next_row(row: Column, symbol: Column, query: str) -> Column:
    """One step of the edit distance: from distances to each beginning of the query, to those after one symbol more."""
    one = F.array(row[0] + 1)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(len(query))) if query else F.array().cast("array<int>"), one,
        lambda got, j: F.concat(got, F.array(F.least(F.element_at(got, -1) + 1, F.get(row, j) + 1, F.get(row, j - 1) + F.when(symbol == F.substring(F.lit(query), j, F.lit(1)), 0).otherwise(1)))),
    )


def edit_distances(texts: DataFrame, column: str, queries: list[str]) -> DataFrame:
    """(value, query, distance) of each distinct value of a column."""
    rows = texts.select(F.col(column).alias("value")).where("value is not null").distinct().select("value", F.explode(literals(queries)).alias("query"))
    return rows.select("value", "query", F.levenshtein("value", "query").cast("long").alias("distance"))


def align(a: str, b: str) -> str:
    """One least-cost alignment: equal symbols as they are, [ab] a substitution, [a-] a deletion, [-b] an insertion."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out.append(a[i - 1] if a[i - 1] == b[j - 1] else f"[{a[i - 1]}{b[j - 1]}]")
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            out.append(f"[{a[i - 1]}-]")
            i -= 1
        else:
            out.append(f"[-{b[j - 1]}]")
            j -= 1
    return "".join(reversed(out))


def alignments(pairs: DataFrame) -> DataFrame:
    """pairs with columns value and query, and their alignment."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align(x, y) for x, y in zip(a, b)])

    return pairs.withColumn("alignment", run("value", "query"))
