"""Reconciliation of a set's local tracks with the catalog's files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.digests import STRENGTH

OUT = "set_id string, ordinal long, remote_ordinal long, algo string, ok boolean, missing array<string>"


def _norm(x, crc=False):
    if x is None or pd.isna(x):
        return None
    x = str(x).strip().lower()
    if crc:
        return x.rjust(8, "0")
    return x or None


def match_algo(local: dict, remote: dict) -> str | None:
    """The strongest digest in which both agree; weaker ones are tried where stronger ones are absent or
    differ. CRC32 counts only with equal sizes."""
    for a in STRENGTH[:3]:
        if (x := _norm(local.get(a))) is not None and x == _norm(remote.get(a)):
            return a
    x, y = _norm(local.get("crc32"), True), _norm(remote.get("crc32"), True)
    return "crc32" if x is not None and x == y and local.get("size_bytes") == remote.get("size_bytes") else None


def assigned(local: list[dict], remote: list[dict]) -> tuple[list[tuple[int | None, str | None]], list[int]]:
    """Greedy one-to-one assignment in local order: each local takes its strongest unused remote, the first
    of equals. Returns (remote index, digest) for each local, and the remotes left over."""
    used: set[int] = set()
    out = []
    for one in local:
        best = None
        for k, other in enumerate(remote):
            if k not in used and (a := match_algo(one, other)) is not None and (best is None or STRENGTH.index(a) < STRENGTH.index(best[1])):
                best = (k, a)
        out.append(best or (None, None))
        if best:
            used.add(best[0])
    return out, [k for k in range(len(remote)) if k not in used]


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row for each local track: the remote it was given, and whether its whole set is verified (every
    local given, no remote left). missing names the remotes left over. A set is a disc's tracks, at most 99
    on each side, so a set fits in a task.

    local: set_id, ordinal, digests, size_bytes; remote: the same and file_name.
    """

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("ordinal").to_dict("records"), b.rename(columns=lambda c: c.removeprefix("r_")).sort_values("ordinal").to_dict("records")
        given, left = assigned(a, b)
        ok = bool(a) and all(k is not None for k, _ in given) and not left
        names = [b[k]["file_name"] for k in left]
        return pd.DataFrame([(key[0], x["ordinal"], None if k is None else b[k]["ordinal"], algo, ok, names) for x, (k, algo) in zip(a, given)], columns=["set_id", "ordinal", "remote_ordinal", "algo", "ok", "missing"]).astype({"remote_ordinal": "Int64"})

    cols = ["set_id", "ordinal", "size_bytes", *STRENGTH[:4]]
    # both sides may come from one table: new names keep their columns apart in the plan
    other = remote.select(*(F.col(c).alias(f"r_{c}") for c in [*cols, "file_name"]))
    return local.select(cols).groupBy("set_id").cogroup(other.groupBy("r_set_id")).applyInPandas(one, OUT)


def unused_remotes(matches: DataFrame, remote: DataFrame) -> DataFrame:
    """Catalog files that no local track was given, by ordinal (names may repeat)."""
    used = matches.where("remote_ordinal is not null").select("set_id", F.col("remote_ordinal").alias("ordinal"))
    return remote.join(used, ["set_id", "ordinal"], "left_anti")
