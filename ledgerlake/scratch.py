"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir and read again: cuts the lineage and survives lost executors.
    The table is removed when the application's JVM ends. Only in local mode may the folder be unset."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/ledgerlake-checkpoints"
    path = f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
