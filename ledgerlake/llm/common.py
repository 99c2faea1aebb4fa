"""Helpers of the training-data operators: tables, the shared scratch folder, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    In local mode, where one process is the whole cluster, it may be unset and a folder of this machine is set;
    on a cluster that would lose what executors write, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/ledgerlake-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. It is removed when the application's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def drop(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: Whether Spark removes a query's shuffle files as soon as it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors.
    Nothing reads the shuffle files of the write again, so they go with it."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables from `written` that nothing reads any more."""
    for df in tables:
        drop(df.sparkSession, df.scratch_path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def as_text(name: str):
    """The column as text; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(taken: list[str], wanted: str) -> str:
    """A column name like `wanted` that differs from all of `taken`, in any case of letters."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


#: What operators hold in this Python worker between tasks: how to let go of it, by operator.
_HELD: dict = {}


def enter(operator: str, let_go=None) -> None:
    """Called where an operator's work starts in a worker: what other operators hold there is let go, so a
    chain of operators in one application needs no more memory than its largest one."""
    others = [k for k in _HELD if k != operator]
    for k in others:
        _HELD.pop(k)()
    if let_go is not None:
        _HELD[operator] = let_go
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # freed memory goes back to the system, where glibc is there
            ctypes.CDLL(None).malloc_trim(0)
