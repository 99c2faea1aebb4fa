"""Rename plans and output conflicts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.names import collision_key, disc_parts, extension, folded, sanitized_stem, stem

LAST_SLOT = 9_999


def target(path: Column, canonical: Column) -> Column:
    """The path under its canonical name: a safe stem, and the extension in lower case."""
    ext = extension(path)
    folder = F.regexp_extract(path, r"^(.*[/\\])?", 1)
    return F.concat(folder, sanitized_stem(canonical), F.when(F.length(ext) > 0, F.concat(F.lit("."), ext)).otherwise(F.lit("")))


def canonical_stem(path: Column, game_name: Column, file_name: Column) -> Column:
    """The catalog file's stem where it has the extension of the local file, else the game's name."""
    return F.coalesce(F.when(extension(file_name) == extension(path), stem(file_name)), game_name)


def counted_collisions(df: DataFrame, key: Column, name: str = "n") -> DataFrame:
    """df with the number of rows that share each row's key: counts are aggregated first, then joined."""
    keyed = df.withColumn("__k", key)
    return keyed.join(keyed.groupBy("__k").agg(F.count("*").alias(name)), "__k", "left").drop("__k")


def rename_plan(candidates: DataFrame) -> DataFrame:
    """candidates (path, game_id, game_name, file_name, verified) with target, action and detail.

    Actions: rename, already_canonical, skip_unmatched, skip_weak_match, skip_disc_set_conflict, skip_collision.
    Files whose stems share a base title are a disc set; one with a member that is not verified or has no game, or
    with games of several base titles, is skipped whole. Of files that would share a target every one is skipped.
    A name that differs in ASCII case alone is canonical already. target is null but for renames.
    """
    base = F.coalesce(disc_parts(F.col("game_name"))["base"], F.lit(""))
    named = candidates.withColumns({"__base": disc_parts(stem(F.col("path")))["base"], "__title": folded(base)})
    weak = ~F.coalesce(F.col("verified"), F.lit(False)) | F.col("game_name").isNull()
    sets = named.groupBy("__base").agg(F.count("*").alias("__n"), F.max(weak).alias("__weak"), (F.min("__title") != F.max("__title")).alias("__mixed")).where("__n > 1 and (__weak or __mixed)")
    named = named.join(sets, "__base", "left")
    to = target(F.col("path"), canonical_stem(F.col("path"), F.col("game_name"), F.col("file_name")))
    safe = sanitized_stem(canonical_stem(F.col("path"), F.col("game_name"), F.col("file_name")))
    action = (
        F.when(F.col("__n").isNotNull(), "skip_disc_set_conflict").when(F.col("game_id").isNull() | F.col("game_name").isNull(), "skip_unmatched")
        .when(~F.coalesce(F.col("verified"), F.lit(False)), "skip_weak_match").when(safe == "", "skip_unmatched")
        .when(collision_key(to) == collision_key(F.col("path")), "already_canonical").otherwise("rename")
    )
    planned = named.withColumns({"__to": to, "__key": collision_key(to), "__action": action})
    claims = planned.where("__action = 'rename'").groupBy("__key").agg(F.count("*").alias("__claims"))
    planned = planned.join(claims, "__key", "left")
    shared = (F.col("__action") == "rename") & (F.col("__claims") > 1)
    final = F.when(shared, "skip_collision").otherwise(F.col("__action"))
    detail = F.when(shared, "two files map to the same target").when(F.col("__weak"), "disc set has an unmatched or weak member").when(F.col("__mixed"), "disc set resolves to different games").when(final == "skip_weak_match", "name+size hint only")
    return planned.select("path", F.when(final == "rename", F.col("__to")).alias("target"), final.alias("action"), detail.alias("detail"))


def conflict_plan(planned: DataFrame, existing: DataFrame, policy: str, key: str = "output") -> DataFrame:
    """planned outputs with `decision` under a policy, given existing outputs (key, valid).

    error, skip and overwrite do what they say; overwrite-invalid rewrites only outputs that do not verify;
    rename takes the first free number, up to 9999 (see `free_slots`)."""
    have = existing.groupBy(key).agg(F.bool_and(F.coalesce("valid", F.lit(True))).alias("__valid"))
    there = F.col("__valid").isNotNull()
    made = {"error": F.lit("error"), "skip": F.lit("skip"), "overwrite": F.lit("overwrite"), "rename": F.lit("rename"), "overwrite-invalid": F.when(F.col("__valid"), "keep_valid").otherwise("rewrite_invalid")}
    return planned.join(have, key, "left").withColumn("decision", F.when(there, made[policy]).otherwise("new")).drop("__valid")


def free_slots(planned: DataFrame, existing: DataFrame, key: str = "output") -> DataFrame:
    """planned with `slot`: the path itself where it is free, else its first free numbered form; null where
    all are taken. Numbered forms are looked up by join, only as far as there are taken ones."""
    stem_, ext = F.regexp_extract(F.col(key), r"^(.*?)(\.[^./\\]*)?$", 1), F.regexp_extract(F.col(key), r"^(.*?)(\.[^./\\]*)?$", 2)
    number = F.regexp_extract(F.col(key), r" \((\d{1,4})\)(\.[^./\\]*)?$", 1)
    family = F.regexp_replace(F.col(key), r" \(\d{1,4}\)(\.[^./\\]*)?$", "$1")
    taken = existing.where(number != "").select(family.alias("__f"), number.cast("int").alias("__n")).where("__n between 1 and 9999").distinct()
    used = taken.groupBy("__f").agg(F.array_sort(F.collect_list("__n")).alias("__used"))
    have = existing.select(key).distinct().withColumn("__there", F.lit(True))
    out = planned.join(have, key, "left").join(used, planned[key] == used["__f"], "left")
    n = F.coalesce(F.size(F.filter("__used", lambda x: x.isNotNull())), F.lit(0))
    first = F.element_at(F.filter(F.sequence(F.lit(1), n + 1), lambda k: ~F.coalesce(F.array_contains("__used", k), F.lit(False))), 1)
    slot = F.when(F.col("__there").isNull(), F.col(key)).when(first <= LAST_SLOT, F.concat(stem_, F.format_string(" (%d)", first), ext))
    return out.withColumn("slot", slot).drop("__there", "__f", "__used")


def execute(plan: list[tuple[str, str]]) -> None:
    """Rename files on the driver as one transaction: all move to stages first, then to their targets; on
    a failure everything moves back."""
    done: list[tuple[str, str]] = []
    staged = [(a, f"{a}.renaming-{k}", b) for k, (a, b) in enumerate(plan)]

    def move(a, b):
        if os.path.exists(b):
            raise FileExistsError(b)
        os.rename(a, b)
        done.append((a, b))

    try:
        for a, s, _ in staged:
            move(a, s)
        for _, s, b in staged:
            move(s, b)
    except BaseException:
        for a, b in reversed(done):
            os.rename(b, a)
        raise

