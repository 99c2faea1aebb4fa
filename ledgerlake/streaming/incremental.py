"""Incremental scans: new files of a folder are identified as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.digests import digests
from ledgerlake.functions.names import basename, is_junk

_ARRIVALS = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arrivals(spark: SparkSession, folder: str, pattern: str = "*", at_once: int = 1000) -> DataFrame:
    """A stream of files (path, name, size_bytes, digests). Whole files pass through memory; use
    `sources.files.hash_files` for large ones."""
    found = spark.readStream.format("binaryFile").schema(_ARRIVALS).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(folder)
    made = {a: c for a, c in digests(F.col("content")).items() if a != "size_bytes"}
    return found.where(~is_junk(F.col("path"))).select("path", basename(F.col("path")).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("seen_at"), *(c.alias(a) for a, c in made.items()))


def scan_stream(spark: SparkSession, folder: str, catalog: DataFrame, games: DataFrame, sink: str, checkpoint: str, pattern: str = "*"):
    """A query that appends the verdict of each new file to a Parquet table, once, across restarts: batches
    that run again overwrite their own part of the table."""
    from ledgerlake.operators.identify import scan

    def put(batch: DataFrame, number: int) -> None:
        local = batch.withColumnRenamed("path", "file_id")
        scan(local, catalog, games).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return arrivals(spark, folder, pattern).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdict_counts(spark: SparkSession, verdicts: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Verdicts by tumbling window of seen_at; works on streams and tables. Rows later than `late` are dropped
    by the watermark on streams."""
    return verdicts.withWatermark("seen_at", late).groupBy(F.window("seen_at", every), "verdict").agg(F.count("*").alias("n"))
