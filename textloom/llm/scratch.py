"""Intermediate tables in the folder that all executors share, and session settings of the text operators."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 2000
ARROW_BYTES = 8 << 20
HOT_ROWS, HOT_KEYS = 512, 10_000
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


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, for the session: whole texts are long. Smaller bounds stay.

    Results are lazy, so the bounds have to hold until they are read; they change no result.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        set_to = re.match(r"\d+$", str(spark.conf.get(f"spark.sql.execution.arrow.{name}")))
        if not set_to or not 0 < int(set_to[0]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


class Scratch:
    """Parquet tables under the shared folder: they cut lineage and outlive the executor that wrote them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/textloom-{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)  # lazy results may still read the tables until the session ends

    def _end(self) -> None:
        try:
            self.drop("")
        except Exception:  # noqa: BLE001  the session is gone already
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def hot_keys(scratch: Scratch, rows: DataFrame, key: str, name: str) -> DataFrame | None:
    """The keys of more than ``HOT_ROWS`` rows that hold over one in ``HOT_KEYS`` of all rows, with the pieces each is dealt into.

    So there are fewer than ``HOT_KEYS`` of them, however large the table, and they may be broadcast.
    """
    limit = max(HOT_ROWS, rows.count() // HOT_KEYS)
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("many")).where(F.col("many") > limit)
    hot = scratch.write(many.select(F.col(key).alias("_hot"), F.ceil(F.col("many") / limit).cast("int").alias("_pieces")), name)
    return hot if hot.head(1) else None


def spread_join(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, by: list[str]) -> DataFrame:
    """Inner join of rows with a table of one row a key; the rows of hot keys are dealt by ``by`` over pieces, each with a copy of that row."""
    if hot is None:
        return rows.join(one, key)
    few = F.broadcast(hot)
    dealt = rows.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_pieces")), F.lit(0)).cast("int"))
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    copied = one.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_piece", F.explode(pieces))
    return dealt.drop("_hot", "_pieces").join(copied.drop("_hot", "_pieces"), [key, "_piece"]).drop("_piece")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    The first collection only lets go of the plans; the second finds their shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
