"""Suffix-tree navigation; a node is a row (id, key, depth, l, r) and each edge one symbol.

Parents and suffix links go from a node's range alone: the node of depth d around a row reaches from the last row at or
before it of which the common prefix with the row above is shorter than d, to the row above the next such one. The common
prefixes (``lcp_array``) are the tree's side data, which can be stored beside the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import _codes, sort_suffixes, windows
from .search import in_text, rows_of


def root(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.lit("").alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("l"), F.length("text").cast("long").alias("r"))


def is_null() -> Column:
    """Whether a node is none: its depth is below 0 or missing."""
    return F.coalesce(F.col("depth") < 0, F.lit(True))


def is_leaf() -> Column:
    return F.col("l") == F.col("r")


def same(one: str, two: str) -> Column:
    """Whether two nodes, given as struct columns, are the same: of one text, depth and range."""
    parts = [F.col(f"{one}.{c}").eqNullSafe(F.col(f"{two}.{c}")) for c in ("id", "depth", "l", "r")]
    return parts[0] & parts[1] & parts[2] & parts[3]


def ends(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Nodes with the positions of their first and last rows."""
    low = index.select("id", F.col("r").alias("l"), F.col("pos").alias("pos_l"))
    high = index.select("id", "r", F.col("pos").alias("pos_r"))
    return nodes.join(low, ["id", "l"]).join(high, ["id", "r"])


def path_labels(nodes: DataFrame, index: DataFrame, docs: DataFrame) -> DataFrame:
    met = in_text(ends(nodes, index), docs, lambda text, x: {"label": F.substring(text, (x["pos_l"] + 1).cast("int"), x["depth"].cast("int"))})
    return met.select("id", "l", "r", "depth", "label")


def unary(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Whether all rows of a node go on with the same symbol: those of its first and last row do (two ends of the text too)."""
    symbol = index.select("id", F.col("pos").alias("at"), F.coalesce("ch", F.lit("")).alias("ch"))
    placed = ends(nodes, index)
    one = symbol.select("id", (F.col("at")).alias("at_l"), F.col("ch").alias("ch_l"))
    two = symbol.select("id", (F.col("at")).alias("at_r"), F.col("ch").alias("ch_r"))
    met = placed.withColumn("at_l", F.col("pos_l") + F.col("depth")).withColumn("at_r", F.col("pos_r") + F.col("depth")).join(one, ["id", "at_l"]).join(two, ["id", "at_r"])
    return met.select("id", "key", (F.col("ch_l") == F.col("ch_r")).alias("is_unary"))


def children(nodes: DataFrame, index: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """All children in order (nth from 1): first the end of the text, with a null symbol, if a row of the node ends there; docs isn't read."""
    symbol = index.select("id", F.col("pos").alias("at"), F.col("ch").alias("sym"))
    hit = rows_of(nodes, index, ["pos"]).withColumn("at", F.col("pos") + F.col("depth")).join(symbol, ["id", "at"])
    found = hit.groupBy("id", "key", "sym", (F.col("depth") + 1).alias("child_depth")).agg(F.min("row").alias("l"), F.max("row").alias("r"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("l")).cast("long"))


def _kasai(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(text)
            sa = sort_suffixes(_codes(text))
            rank = np.empty(n + 1, np.int64)
            rank[sa] = np.arange(n + 1)
            above = np.append(-1, sa[:-1])[rank].tolist()
            lcp, got = np.zeros(n + 1, np.int64), 0
            for i, j in enumerate(above):  # by position: the next suffix shares at most one symbol less with the one above it
                if j < 0:
                    got = 0
                    continue
                while i + got < n and j + got < n and text[i + got] == text[j + got]:
                    got += 1
                lcp[rank[i]] = got
                got = max(0, got - 1)
            for a in range(0, n + 1, 100_000):
                part = lcp[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(part), pa.int64()), pa.array(np.arange(a, a + len(part))), pa.array(part)], names=["id", "r", "lcp"])


def lcp_array(index: DataFrame | None, docs: DataFrame) -> DataFrame:
    """(id, r, lcp): common prefix of the suffixes of rows r - 1 and r; 0 for row 0. Linear in a text, where the text is; index isn't read."""
    return docs.select("id", "text").mapInArrow(_kasai, "id long, r long, lcp long")


def canonize(nodes: DataFrame, index: DataFrame, docs: DataFrame, lcp: DataFrame | None = None) -> DataFrame:
    """The deepest node with the same rows: the least common prefix within its range (for a leaf, its whole suffix)."""
    lcp = lcp_array(index, docs) if lcp is None else lcp
    inner = rows_of(nodes.where("l < r").withColumn("l", F.col("l") + 1), lcp, ["lcp"])
    wide = inner.groupBy("id", "key", (F.col("l") - 1).alias("l"), "r").agg(F.min("lcp").alias("depth"))
    length = index.groupBy("id").agg((F.count("*") - 1).alias("n"))
    leaf = nodes.where("l = r").join(index.select("id", F.col("r").alias("l"), "pos"), ["id", "l"]).join(length, "id")
    return wide.select("id", "key", "l", "r", "depth").unionByName(leaf.select("id", "key", "l", "r", (F.col("n") - F.col("pos")).alias("depth")))


def around(nodes: DataFrame, lcp: DataFrame) -> DataFrame:
    """Nodes (id, key, depth, l, r) whose range is widened to all rows that share the first ``depth`` symbols with theirs."""
    met = nodes.join(lcp.select("id", F.col("r").alias("row"), "lcp"), "id").where((F.col("lcp") < F.col("depth")) | (F.col("row") == 0))
    found = met.groupBy("id", "key", "depth", "l", "r").agg(
        F.max(F.when(F.col("row") <= F.col("l"), F.col("row"))).alias("low"), F.min(F.when(F.col("row") > F.col("r"), F.col("row"))).alias("high")
    )
    rows = lcp.groupBy("id").agg(F.count("*").alias("rows"))
    return found.join(rows, "id").select("id", "key", "depth", F.coalesce("low", F.lit(0)).alias("l"), (F.coalesce("high", "rows") - 1).alias("r"))


def parents(nodes: DataFrame, lcp: DataFrame) -> DataFrame:
    """(id, key, depth, l, r): the node without its last symbol; the root has none."""
    return around(nodes.where("depth > 0").withColumn("depth", F.col("depth") - 1), lcp)


def suffix_links(nodes: DataFrame, index: DataFrame, lcp: DataFrame) -> DataFrame:
    """(id, key, depth, l, r): the node without its first symbol: psi leads from its first and last row into it."""
    one = index.select("id", F.col("r").alias("l"), F.col("psi").alias("to_l"))
    two = index.select("id", "r", F.col("psi").alias("to_r"))
    met = nodes.where("depth > 0").join(one, ["id", "l"]).join(two, ["id", "r"])
    return around(met.select("id", "key", (F.col("depth") - 1).alias("depth"), F.col("to_l").alias("l"), F.col("to_r").alias("r")), lcp)


def all_nodes(index: DataFrame, docs: DataFrame, deepest: int) -> DataFrame:
    """(id, label, depth, l, r) of all nodes to a depth, the root included."""
    placed = index.select("id", "r", "pos").join(windows(docs, deepest), ["id", "pos"])
    rows = placed.select("id", "r", F.explode(F.transform(F.sequence(F.lit(0), F.length("part")), lambda k: F.substring("part", F.lit(1), k))).alias("label"))
    return rows.groupBy("id", "label").agg(F.min("r").alias("l"), F.max("r").alias("r")).select("id", "label", F.length("label").cast("long").alias("depth"), "l", "r")
