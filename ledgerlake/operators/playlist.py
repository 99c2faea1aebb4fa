"""Multi-part groups: discs of one title, tracks of one cue sheet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.names import disc_parts, stem


def groups(parts: DataFrame, base: str, number: str, path: str) -> DataFrame:
    """(base, members, n, duplicated): members in order of number, then path, across folders."""
    in_order = F.array_sort(F.collect_list(F.struct(F.col(number).alias("number"), F.col(path).alias("path"))))
    return parts.groupBy(base).agg(F.transform(in_order, lambda m: m["path"]).alias("members"), F.count("*").alias("n"), (F.count("*") > F.count_distinct(number)).alias("duplicated"))


def disc_groups(files: DataFrame, path: str = "path") -> DataFrame:
    """Files by base title. A title without a disc token is disc 0 and may join a numbered group."""
    parts = files.withColumn("__d", disc_parts(stem(F.col(path)))).select(F.col("__d.base").alias("base"), F.col("__d.disc").alias("number"), path)
    return groups(parts, "base", "number", path)


def uncovered(files: DataFrame, cues: DataFrame, path: str = "path") -> DataFrame:
    """Files that no cue sheet names (cues: members array)."""
    return files.join(cues.select(F.explode("members").alias(path)).distinct(), path, "left_anti")


def playlist_text(members: Column, folder_of: str | None = None) -> Column:
    """The lines of a playlist: members relative to its folder, forward slashes."""
    rel = F.transform(members, lambda m: F.replace(m, F.lit("\\"), F.lit("/")))
    if folder_of is not None:
        root = folder_of.rstrip("/") + "/"
        rel = F.transform(rel, lambda m: F.when(m.startswith(root), F.substring(m, len(root) + 1, 1 << 30)).otherwise(m))
    return F.concat(F.array_join(rel, "\n"), F.lit("\n"))


def write_playlists(groups_: DataFrame, folder: str, least: int = 2) -> int:
    """One .m3u for each group of at least `least` members; groups stream through the driver."""
    from ledgerlake.operators.report import published

    n = 0
    rows = groups_.where(F.size("members") >= least).select("base", playlist_text(F.col("members"), folder).alias("text"))
    for r in rows.toLocalIterator():
        with published(os.path.join(folder, f"{r.base}.m3u")) as out:
            out.write(r.text)
        n += 1
    return n
