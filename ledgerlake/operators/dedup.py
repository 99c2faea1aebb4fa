"""Files with equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.digests import STRENGTH


def strongest(columns: list[str]):
    """The strongest digest that a row carries."""
    return F.coalesce(*(F.col(a) for a in STRENGTH if a in columns))


def by_content(files: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(content, keep, copies): the smallest id and the number of files for each distinct content. Files
    without any digest are left out."""
    return files.select(strongest(files.columns).alias("content"), file_id).where("content is not null").groupBy("content").agg(F.min(file_id).alias("keep"), F.count("*").alias("copies"))
