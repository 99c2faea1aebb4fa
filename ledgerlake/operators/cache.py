"""The digest cache: lookups, misses and merges by path, size and modification time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("path", "size", "mtime_secs", "mtime_nanos")
#: Files changed within so many seconds are never trusted.
RECENT = 2


def lookup(files: DataFrame, cache: DataFrame, wanted: tuple[str, ...], side: str = "raw") -> DataFrame:
    """files with `cached`: the entry's digests where path, size and time agree and no wanted digest is null."""
    whole = F.lit(True)
    for a in wanted:
        whole = whole & F.col(f"{side}.{a}").isNotNull()
    return files.join(cache.where(whole).select(*KEY, F.col(side).alias("cached")), list(KEY), "left")


def misses(files: DataFrame, cache: DataFrame, wanted: tuple[str, ...], side: str = "raw") -> DataFrame:
    return lookup(files, cache, wanted, side).where("cached is null").drop("cached")


def set_lookup(sets: DataFrame, cache: DataFrame) -> DataFrame:
    """Cue sets (path, members: array of size, secs, nanos) whose members all agree, in order."""
    return sets.join(cache.select("path", F.col("members").alias("__m"), "whole", "tracks"), "path", "left").where(F.col("members") == F.col("__m")).drop("__m")


def merged(old: DataFrame, new: DataFrame, key: str, digests: tuple[str, ...]) -> DataFrame:
    """The union of both by key; each digest is the new one where there is one."""
    o, n = old.select(key, *(F.col(d).alias(f"old_{d}") for d in digests)), new.select(key, *digests)
    return o.join(n, key, "full").select(key, *(F.coalesce(d, f"old_{d}").alias(d) for d in digests))


def rebuilt(fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """Fresh entries, and the cache's entries for paths that were not touched."""
    return fresh.unionByName(cache.join(fresh.select("path"), "path", "left_anti"))


def storable(files: DataFrame, now: float) -> DataFrame:
    """Files that are old enough to be cached; times in the future count as recent."""
    return files.where(F.lit(now) - F.col("mtime_secs") >= RECENT)


def remember_valid(cache: DataFrame, verified: DataFrame) -> DataFrame:
    """Adds labels of successful checks (path, label) to verify_valid; failures are not stored."""
    labels = verified.groupBy("path").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("label", F.lit(True))))).alias("__new"))
    out = cache.join(labels, "path", "left")
    empty = F.expr("cast(map() as map<string,boolean>)")
    have = F.map_filter(F.coalesce("verify_valid", empty), lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    return out.withColumn("verify_valid", F.map_concat(have, F.coalesce("__new", empty))).drop("__new")


# Fixed value: an entry of the stored cache.
_DIGESTS = "struct<crc32:string,sha1:string,md5:string,sha256:string,size_bytes:bigint>"
ENTRY = f"path string, size bigint, mtime_secs bigint, mtime_nanos int, raw {_DIGESTS}, decoded {_DIGESTS}, whole {_DIGESTS}, tracks array<struct<number:int,kind:string,digests:{_DIGESTS}>>, members array<struct<size:bigint,secs:bigint,nanos:int>>, verify_valid map<string,boolean>"


def save(cache: DataFrame, folder: str) -> None:
    """Write the cache as gzipped JSON lines. The new table is complete before it takes the old one's place."""
    import uuid

    spark = cache.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fresh, old = path(f"{folder.rstrip('/')}.{uuid.uuid4().hex}"), path(folder)
    cache.write.option("compression", "gzip").json(fresh.toString())
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(fresh, old):
        raise OSError(f"could not put the cache at {folder}")


def load(spark, folder: str) -> DataFrame:
    """The stored cache; fields that an older one lacks are null, lines that can't be read are left out, and a folder
    that is not there is an empty cache."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(folder).where("path is not null")
