"""Identification of files against a catalog of known digests, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.digests import STRENGTH, norm_crc, norm_hash
from ledgerlake.functions.names import stem

#: Digest columns of both sides; a CRC32 counts only with equal size.
DIGESTS = ("sha256", "sha1", "md5", "crc32")


def rung_keys(df: DataFrame, id_: str, name: str, size: str, keep: tuple = (), whole: bool = False) -> DataFrame:
    """One row (id, rung, key) for each way in which a file can be found; rung 0 is the strongest. Blank
    and null digests give no row; with `whole` a file without any has one row of nulls."""
    sized = {"crc32": F.concat(norm_crc(norm_hash(F.col("crc32"))), F.lit("/"), F.col(size).cast("string")), "name_size": F.concat(F.col(name), F.lit("/"), F.col(size).cast("string"))}
    ways = [F.struct(F.lit(k).alias("rung"), (sized[a] if a in sized else norm_hash(F.col(a))).alias("key")) for k, a in enumerate(STRENGTH) if a in df.columns or a == "name_size"]
    each = F.explode_outer if whole else F.explode
    out = df.select(F.col(id_), *keep, each(F.filter(F.array(*ways), lambda w: w["key"].isNotNull())).alias("w"))
    return out.select(*[c for c in out.columns if c != "w"], "w.rung", "w.key")


def identify(local: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rows of local (file_id, name, size_bytes and digests) with catalog_id, game_id and rung of the
    strongest match, the smallest catalog_id of several; null where there is none.

    Both sides become (rung, key) rows, so one equi-join serves all rungs. The catalog is reduced to a row a
    key first: equal content that occurs often on both sides never multiplies. Rows carry the local columns along,
    so files are read and digested once; file_id names a row of local, and rows that repeat it count once.
    """
    known = rung_keys(catalog, "catalog_id", "file_name", "size_bytes", ("game_id",))
    known = known.groupBy("rung", "key").agg(F.min(F.struct("catalog_id", "game_id")).alias("hit"))
    rest = [c for c in local.columns if c != "file_id"]
    ways = rung_keys(local, "file_id", "name", "size_bytes", (F.struct(*rest).alias("own"),), whole=True)
    found = ways.join(known, ["rung", "key"], "left")
    best = found.groupBy("file_id").agg(F.min("own").alias("own"), F.min(F.when(F.col("hit").isNotNull(), F.struct("rung", "hit"))).alias("b"))
    return best.select("file_id", "own.*", F.col("b.hit.catalog_id").alias("catalog_id"), F.col("b.hit.game_id").alias("game_id"), F.col("b.rung").alias("rung"))


def algorithm(rung: Column) -> Column:
    return F.get(F.array(*map(F.lit, STRENGTH)), rung)


def verdict(rung: Column, local_name: Column, game_name: Column) -> Column:
    """unknown without a match, hint by name and size only; else misnamed where the stem differs from the
    game's name, and verified where it agrees or there is no name to compare."""
    differs = F.lower(stem(local_name)) != F.lower(game_name)
    return F.when(rung.isNull(), "unknown").when(rung == len(STRENGTH) - 1, "hint").when(F.coalesce(differs, F.lit(False)), "misnamed").otherwise("verified")


def scan(local: DataFrame, catalog: DataFrame, games: DataFrame) -> DataFrame:
    """identify, with the games' names (game_id, game_name) and verdicts."""
    named = identify(local, catalog).join(games, "game_id", "left")
    return named.withColumns({"match_algo": algorithm(F.col("rung")), "verdict": verdict(F.col("rung"), F.col("name"), F.col("game_name"))})


def escalate(first: DataFrame, digest_more, catalog: DataFrame) -> DataFrame:
    """Two passes by cost: only rows whose first verdict is hint are digested again (digest_more maps them
    to rows with the dearer digests) and identified anew; unknown rows stay as they are."""
    again = first.where("verdict = 'hint'").drop("catalog_id", "game_id", "rung", "verdict")
    second = identify(digest_more(again), catalog)
    second = second.withColumn("verdict", F.when(F.col("rung").isNull(), "unknown").when(F.col("rung") == len(STRENGTH) - 1, "hint").otherwise("verified"))
    return first.where("verdict <> 'hint'").unionByName(second.select(*[c for c in first.columns if c in second.columns]), allowMissingColumns=True)
