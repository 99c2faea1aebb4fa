"""Catalog files that a library lacks, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.digests import norm_crc

#: The ladder: a catalog row is looked up by the strongest digest it carries, and by no other.
LADDER = ("sha256", "sha1", "md5")


def _clean(c: str):
    return F.lower(F.trim(F.col(c)))


def local_index(local: DataFrame) -> DataFrame:
    """Distinct (rung, key) of all local digests."""
    ways = [F.struct(F.lit(a).alias("rung"), _clean(a).alias("key")) for a in LADDER if a in local.columns]
    if "crc32" in local.columns:
        ways.append(F.struct(F.lit("crc32").alias("rung"), F.concat(norm_crc(F.col("crc32")), F.lit("/"), F.col("size_bytes").cast("string")).alias("key")))
    return local.select(F.explode(F.array(*ways)).alias("w")).select("w.rung", "w.key").where("key is not null").distinct()


def missing(catalog: DataFrame, local: DataFrame) -> DataFrame:
    """Catalog rows not held locally. Rows without any digest are always missing."""
    crc = F.concat(norm_crc(F.col("crc32")), F.lit("/"), F.col("size_bytes").cast("string")) if "crc32" in catalog.columns else F.lit(None).cast("string")
    rung = F.coalesce(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a in LADDER], F.when(crc.isNotNull(), F.lit("crc32")))
    key = F.coalesce(*[_clean(a) for a in LADDER], crc)
    marked = catalog.withColumns({"rung": rung, "key": key})
    return marked.join(local_index(local), ["rung", "key"], "left_anti").select(catalog.columns)


def missing_by_game(catalog: DataFrame, local: DataFrame) -> DataFrame:
    return missing(catalog, local).groupBy("game_id").agg(F.count("*").alias("missing"))


def fixdat_xml(missing_files: DataFrame) -> DataFrame:
    """One row (game_name, xml) for each game: its element of the report, files in source order. Write the
    rows in order between header and footer."""
    from ledgerlake.functions.texts import xml_escape

    def attr(n, c):
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {n}="'), xml_escape(F.col(c).cast("string")), F.lit('"'))).otherwise(F.lit(""))

    rom = F.concat(F.lit("\t\t<rom"), attr("name", "file_name"), attr("size", "size_bytes"), attr("crc", "crc32"), attr("md5", "md5"), attr("sha1", "sha1"), attr("sha256", "sha256"), F.lit("/>"))
    rows = missing_files.withColumn("rom", rom).groupBy("game_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rom"))).alias("roms"))
    game = xml_escape(F.col("game_name"))
    body = F.array_join(F.transform("roms", lambda r: r["rom"]), "\n")
    return rows.select("game_name", F.concat(F.lit('\t<game name="'), game, F.lit('">\n\t\t<description>'), game, F.lit("</description>\n"), body, F.lit("\n\t</game>")).alias("xml"))


def fixdat_header(name: str, version: str = "") -> str:
    from xml.sax.saxutils import escape

    def esc(x):
        return escape(x, {'"': "&quot;", "'": "&apos;"})

    title = esc(f"fixdat - {name}")
    return ('<?xml version="1.0"?>\n<!DOCTYPE datafile PUBLIC "-//Logiqx//DTD ROM Management Datafile//EN" "http://www.logiqx.com/Dats/datafile.dtd">\n<datafile>\n'
            f"\t<header>\n\t\t<name>{title}</name>\n\t\t<description>{title}</description>\n\t\t<version>{esc(version)}</version>\n\t</header>\n")


def write_fixdat(missing_files: DataFrame, path: str, name: str, version: str = "") -> int:
    """Write the report to one file on the driver and return how many games it lists. Games stream in by
    name; only one is held at a time."""
    from ledgerlake.operators.report import published

    n = 0
    with published(path) as out:
        out.write(fixdat_header(name, version))
        for row in fixdat_xml(missing_files).orderBy("game_name").toLocalIterator():
            out.write(row.xml + "\n")
            n += 1
        out.write("</datafile>\n")
    return n
