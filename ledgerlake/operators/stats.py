"""Statistics of repeated runs, container summaries and queue totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def warm(samples: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """(group, mean, sigma) without each group's first run; sigma is of the population. Groups of a single
    run have none."""
    first = samples.groupBy(*group).agg(F.min(F.struct(*order)).alias("__f"))
    return samples.join(first, group).where(F.struct(*order) > F.col("__f")).groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"))


def warm_by_window(samples: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """As `warm` where the order may tie: exactly one run of each group is left out."""
    w = Window.partitionBy(*group).orderBy(*order)
    return samples.withColumn("__k", F.row_number().over(w)).where("__k > 1").groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"))


def block_summary(blocks: DataFrame) -> DataFrame:
    """(container, n_blocks, n_raw, stored, logical, compression_ratio): the ratio is stored over logical,
    in percent."""
    out = blocks.groupBy("container").agg(F.count("*").alias("n_blocks"), F.count_if("raw").alias("n_raw"), F.sum("stored_len").alias("stored"), F.sum("expected_len").alias("logical"))
    return out.withColumn("compression_ratio", F.when(F.col("logical") > 0, F.col("stored") / F.col("logical") * 100))


def partition_summary(members: DataFrame) -> DataFrame:
    return members.groupBy("container", "partition").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size"))


def saved_bytes(size_in: Column, size_out: Column) -> Column:
    return F.sum(F.greatest(size_in - size_out, F.lit(0)))


def highest_update(titles: DataFrame, family: str, version: str) -> DataFrame:
    return titles.groupBy(family).agg(F.max(version).alias("update_version"))


def sampled(mismatches: DataFrame, group: str, order: str, most: int = 8) -> DataFrame:
    """(group, n, sample): how many mismatches, and the first few. A report, so the rest is only counted."""
    w = Window.partitionBy(group).orderBy(order)
    few = mismatches.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    picked = few.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("sample"))
    return mismatches.groupBy(group).agg(F.count("*").alias("n")).join(picked, group)


def verify_tally(results: DataFrame, *group: str) -> DataFrame:
    """(group, total, ok, failed, passed) of results with a column valid; null counts as failed."""
    good = F.coalesce(F.col("valid"), F.lit(False))
    return results.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), (F.count_if(~good) == 0).alias("passed"))


def batch_summary(results: DataFrame, *group: str) -> DataFrame:
    """(group, ok, failed, skipped, size_in, size_out, ms): skipped and failed files add no sizes."""
    done = F.col("status") == "ok"
    return results.groupBy(*group).agg(F.count_if(done).alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum(F.when(done, F.col("size_in"))), F.lit(0)).alias("size_in"), F.coalesce(F.sum(F.when(done, F.col("size_out"))), F.lit(0)).alias("size_out"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"))


def referenced_size(references: DataFrame, files: DataFrame, cue: str, path: str, size: str) -> DataFrame:
    """(cue, total, n_missing): the bytes of the files that each cue sheet names, and how many are not there. A file
    that is named twice counts twice."""
    joined = references.join(files.groupBy(path).agg(F.max(size).alias("__s")), path, "left")
    return joined.groupBy(cue).agg(F.coalesce(F.sum("__s"), F.lit(0)).alias("total"), F.count_if(F.col("__s").isNull()).alias("n_missing"))


def restitched(asked: DataFrame, answers: DataFrame, index: str) -> DataFrame:
    """Answers of a bulk lookup beside what was asked, by ordinal. Each ordinal must be answered exactly once, else
    the job fails."""
    counted = answers.groupBy(index).agg(F.count("*").alias("__n"), F.min(F.struct(*[c for c in answers.columns if c != index])).alias("__a"))
    both = asked.join(counted, index, "full")
    sound = both.withColumn("__n", F.when((F.col("__n") == 1) & F.col(asked.columns[0]).isNotNull(), F.col("__n")).otherwise(F.raise_error(F.lit("an ordinal is not answered exactly once")).cast("long")))
    return sound.where("__n = 1").select(*asked.columns, "__a.*")


def smallest(tried: DataFrame, item: str, order: str, size: str, what: str) -> DataFrame:
    """(item, what, size): of several encodings the smallest; the one tried first of equals."""
    best = tried.groupBy(item).agg(F.min(F.struct(size, order, what)).alias("b"))
    return best.select(item, F.col(f"b.{what}").alias(what), F.col(f"b.{size}").alias(size))


def bucket(error: Column, kind: Column) -> Column:
    """What a digest error makes of its file: null without one, unsupported for inner formats that can't be read,
    failed for others. Transport errors and cancelling end the job."""
    fatal = F.raise_error(F.concat(F.lit("stopped: "), F.coalesce(error, F.lit("")))).cast("string")
    return F.when(kind.isin("transport", "cancelled"), fatal).when(kind == "unsupported", "unsupported").when(error.isNotNull() | kind.isNotNull(), "failed")


# Exit codes of a whole run.
EXIT = {"ok": 0, "failed": 1, "invalid_argument": 2, "partial_failure": 3, "cancelled": 130, "internal_error": 255}


def response(summary: DataFrame) -> DataFrame:
    """(code, status, ok) added to `batch_summary` rows: ok without failures, partial_failure with some of each."""
    code = F.when(F.col("failed") == 0, "ok").when(F.col("ok") > 0, "partial_failure").otherwise("failed")
    table = F.create_map(*(F.lit(x) for pair in EXIT.items() for x in pair))
    return summary.withColumn("code", code).withColumn("status", table[F.col("code")])
