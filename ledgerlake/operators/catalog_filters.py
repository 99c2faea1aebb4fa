"""Selections from catalog tables, and checks before a run."""

from __future__ import annotations

import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Free bytes that a run leaves.
HEADROOM = 256 << 20


def external_ids(metadata: Column) -> Column:
    """Of external metadata entries, those matched automatically or by hand that carry a provider's id."""
    return F.filter(metadata, lambda m: m["match_type"].isin("Automatic", "Manual") & m["provider_id"].isNotNull())


def dat_files(dats: DataFrame, platform: str | None = None, group: str | None = None, name: str | None = None, subset: str | None = None, tag: str | None = None) -> DataFrame:
    """DAT files by any of platform, signature group, part of the name, subset and tag."""
    tests = [
        platform and F.col("platform_id") == platform, group and F.col("signature_group_id") == group, subset and F.col("subset") == subset,
        name and F.contains(F.lower("name"), F.lit(name.lower())), tag and F.array_contains("tags", tag),
    ]
    for t in tests:
        if isinstance(t, Column):
            dats = dats.where(t)
    return dats


def display_fields(found: DataFrame) -> DataFrame:
    """dat_file_name and dat_version: the DAT file's name first, but the import's version first."""
    return found.withColumns({"dat_file_name": F.coalesce("dat_file.name", "dat_import.name"), "dat_version": F.coalesce("dat_import.version", "dat_file.current_version")})


def warnings(files: DataFrame) -> DataFrame:
    """One row of what is easy to get wrong: several kinds of input at once, and empty files."""
    return files.agg((F.count_distinct("ext") > 1).alias("mixed_extensions"), F.count_if(F.col("size_bytes") == 0).alias("empty_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def fits(files: DataFrame, folder: str) -> bool:
    """Whether a folder has room for the files' sizes beside the headroom."""
    need = files.agg(F.sum("size_bytes")).first()[0] or 0
    return shutil.disk_usage(folder).free >= need + HEADROOM
