"""Reading texts and symbol files, writing and reading indexes, and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import as_little_endian, from_code_point

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="textloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        found = _OWN[0]
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the cluster's checkpoint folder, so that loops don't grow the plan."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def texts(table: DataFrame, ids: str, text: str) -> DataFrame:
    """Any table as (id, text); null texts have no index and are left out."""
    return table.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (id, text), the id a hash of the path; bytes that aren't UTF-8 are an error on use."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("id"), F.decode("content", "UTF-8").alias("text"))


def read_symbols(spark: SparkSession, path: str, width: int = 1) -> DataFrame:
    """Files of little-endian integers of ``width`` bytes as sequences (id, i, sym)."""
    files = spark.read.format("binaryFile").load(path)
    n = (F.length("content") / width).cast("int")
    at = files.select(F.xxhash64("path").alias("id"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).where(F.col("i") >= 0)
    digits = F.concat(*[F.hex(F.expr(f"substring(content, i * {width} + {k}, 1)")) for k in range(width, 0, -1)])
    return at.select("id", F.col("i").cast("long"), F.conv(digits, 16, 10).cast("long").alias("sym"))


def read_bwt(spark: SparkSession, symbols: str, last: str, width: int = 1, size: int | None = None) -> DataFrame:
    """(id, r, bw) from a BWT file of fixed-width symbols without its end-of-text row, and a file with that row's number.

    Symbols are code points. With ``size``, a symbol that isn't smaller is an error. One text, with id 0.
    """
    at = int(spark.read.text(last).head().value)
    rows = read_symbols(spark, symbols, width)
    if size is not None:
        rows = rows.withColumn("sym", F.when(F.col("sym") < size, F.col("sym")).otherwise(F.raise_error(F.concat(F.lit("symbol out of range: "), "sym"))))
    moved = rows.select(F.lit(0).cast("long").alias("id"), F.when(F.col("i") < at, F.col("i")).otherwise(F.col("i") + 1).alias("r"), from_code_point(F.col("sym")).alias("bw"))
    return moved.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(at).cast("long").alias("r"), F.lit(None).cast("string").alias("bw")))


def bwt_bytes(bwt: DataFrame, width: int = 1) -> DataFrame:
    """(id, symbols, last) from (id, r, bw): what a BWT file of fixed-width little-endian symbols holds, and the row left out of it.

    For texts that fit into a row. Symbols are code points, which have to fit into the width.
    """
    cells = F.array_sort(F.collect_list(F.when(F.col("bw").isNotNull(), F.struct("r", F.hex(as_little_endian(F.ascii("bw"), width)).alias("x")))))
    found = bwt.groupBy("id").agg(cells.alias("cells"), F.max(F.when(F.col("bw").isNull(), F.col("r"))).alias("last"))
    return found.select("id", F.unhex(F.array_join(F.transform("cells", lambda c: c["x"]), "")).alias("symbols"), "last")


def save_index(index: DataFrame, path: str, buckets: int | None = None, order: str = "r") -> None:
    """Writes an index sorted by (id, r), so that row-group statistics skip what a lookup doesn't need; its side tables alike."""
    laid = index.repartition(buckets, "id") if buckets else index.repartition("id")
    laid.sortWithinPartitions("id", order).write.mode("overwrite").parquet(path)


def save_packed(packed: DataFrame, path: str) -> None:
    """Writes a packed index where it is made: its rows are whole texts, so nothing has to be brought together."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
