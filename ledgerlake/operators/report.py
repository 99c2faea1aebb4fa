"""Reports of conversions, digests and verdicts: rows, totals and files."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.texts import csv_field, html_escape

VERDICTS = ("verified", "misnamed", "hint", "unknown", "unsupported", "failed")


def tally(df: DataFrame, status: Column, size_in: Column, size_out: Column | None = None) -> DataFrame:
    """Counts by status in one row, and byte sums over ok rows only."""
    ok = status == "ok"
    out = [F.count_if(status == s).alias(f"n_{s}") for s in ("ok", "skipped", "failed")]
    out.append(F.coalesce(F.sum(F.when(ok, size_in)), F.lit(0)).alias("bytes_in"))
    if size_out is not None:
        out.append(F.coalesce(F.sum(F.when(ok, size_out)), F.lit(0)).alias("bytes_out"))
    return df.agg(*out)


def runner_totals(df: DataFrame, status: Column, size_in: Column, size_out: Column) -> DataFrame:
    """As `tally`, but bytes of all rows count."""
    return df.agg(*(F.count_if(status == s).alias(f"n_{s}") for s in ("ok", "skipped", "failed")), F.coalesce(F.sum(size_in), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum(size_out), F.lit(0)).alias("bytes_out"))


def dat_totals(df: DataFrame, status: Column, size: Column) -> DataFrame:
    """Totals of a verdict report: all sizes count, nothing counts as skipped."""
    return df.agg(F.count_if(status != "failed").alias("n_ok"), F.lit(0).alias("n_skipped"), F.count_if(status == "failed").alias("n_failed"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_in"))


def status_of(n_ok: Column, n_failed: Column) -> Column:
    return F.when(n_failed == 0, "ok").when(n_ok == 0, "failed").otherwise("partial")


def by_verdict(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    return df.groupBy(verdict).agg(F.count("*").alias("n"))


@contextlib.contextmanager
def published(path: str):
    """A text file that appears under its name only when it is whole."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            yield out
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)
        raise


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    return df.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)).alias("value"))


def html_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns or df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def write_report(df: DataFrame, path: str, order: list[str], title: str = "Report") -> None:
    """One file by its extension: csv, html, else JSON. Rows stream through the driver in order. For large
    reports write csv_lines(df) with Spark's text writer instead."""
    rows = df.orderBy(*order)
    kind = os.path.splitext(path)[1].lower()
    with published(path) as out:
        if kind == ".csv":
            out.write(",".join(df.columns) + "\n")
            for r in csv_lines(rows, df.columns).toLocalIterator():
                out.write(r.value + "\n")
        elif kind in (".html", ".htm"):
            head = "".join(f"<th>{c}</th>" for c in df.columns)
            out.write(f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{title}</title></head><body><table><tr>{head}</tr>\n")
            for r in html_rows(rows, df.columns).toLocalIterator():
                out.write(r.value + "\n")
            out.write("</table></body></html>\n")
        else:
            out.write("[")
            for k, r in enumerate(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator()):
                out.write(("," if k else "") + "\n" + r.value)
            out.write("\n]\n")


def read_report(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
