"""A directory of tables or workbooks as a stream: what was added, removed and rewritten, and re-indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) of two snapshots (key, hash): a full outer join."""
    j = before.select("key", F.col("hash").alias("old")).join(after.select("key", F.col("hash").alias("new")), "key", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "rewritten")
    return j.withColumn("change", change).filter("change is not null").select("key", "change")


def files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """A stream of files with their content hashes."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(directory)
    return raw.select("path", "modificationTime", F.sha2("content", 256).alias("hash"), "content")


def reindex(spark: SparkSession, directory: str, put: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*", once: bool = True) -> StreamingQuery:
    """Hand each batch of new files to `put`, which must be safe to repeat: a batch can come twice."""
    query = files(spark, directory, pattern).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="400 milliseconds")).start()


def quiet(events: DataFrame, key: str = "path", at: str = "modificationTime", gap: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of changes to a key as one: a session ends after a quiet gap."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("changes"))
