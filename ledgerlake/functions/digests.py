"""Digests of content and comparison of digest texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the cheapest to the dearest digest to compute, and from the strongest match to the weakest.
COST = ("crc32", "md5", "sha1", "sha256")
STRENGTH = ("sha256", "sha1", "md5", "crc32", "name_size")


def crc32(content: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def digests(content: Column, algorithms: tuple[str, ...] = COST) -> dict[str, Column]:
    """The wanted digests of a text or binary column, lower-case hex, and size_bytes."""
    made = {"crc32": crc32(content), "md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}
    return {a: made[a] for a in algorithms} | {"size_bytes": F.octet_length(content).cast("long")}


def norm_hash(h: Column) -> Column:
    """Trimmed, lower case; blank counts as absent."""
    t = F.lower(F.trim(h))
    return F.when(F.length(t) > 0, t)


def norm_crc(h: Column) -> Column:
    """Trimmed, lower case, filled with zeros to eight digits; longer texts stay as they are."""
    t = F.lower(F.trim(h))
    return F.when(F.length(t) < 8, F.lpad(t, 8, "0")).otherwise(t)


def hashes_equal(a: Column, b: Column) -> Column:
    return F.coalesce(norm_hash(a) == norm_hash(b), F.lit(False))


def crc_equal(a: Column, b: Column) -> Column:
    return F.coalesce(norm_crc(a) == norm_crc(b), F.lit(False))


def split_bounds(requested: tuple[str, ...] = COST, low: str = "crc32", high: str = "sha256") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(digests of the first pass, digests that escalation adds) of the requested ones, in their order.

    The first pass has those up to `low` in cost. Where none is that cheap, all are computed at once. A bound below
    the other and a requested digest above `high` are errors.
    """
    if {low, high, *requested} - set(COST):
        raise ValueError(f"unknown digests: {sorted({low, high, *requested} - set(COST))}")
    a, b = COST.index(low), COST.index(high)
    if a > b:
        raise ValueError(f"the least digest {low} is above the greatest {high}")
    if above := [x for x in requested if COST.index(x) > b]:
        raise ValueError(f"{above[0]} is above the greatest digest {high}")
    first = tuple(x for x in requested if COST.index(x) <= a)
    return (first, tuple(x for x in requested if x not in first)) if first else (tuple(requested), ())


def primary(whole: Column, single: Column) -> Column:
    """The digests that stand for a file: those of the whole set where it has tracks."""
    return F.coalesce(whole, single)


def parse_algorithms(text: str) -> tuple[str, ...]:
    """A comma-separated list of digests, in column order, without repeats."""
    wanted = [x.strip().lower() for x in text.split(",") if x.strip()]
    unknown = [x for x in wanted if x not in COST]
    if unknown or not wanted:
        raise ValueError(f"unknown digests: {unknown or text!r}")
    return tuple(a for a in ("crc32", "sha1", "md5", "sha256") if a in wanted)
