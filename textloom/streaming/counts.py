"""Pattern counts over a stream of texts: no state, so the batch expression runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import count_patterns


def count_stream(texts: DataFrame, patterns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes (id, pattern, occ) of each arriving text to Parquet, once each, until the available input is read."""
    counted = count_patterns(texts, patterns)
    return counted.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
