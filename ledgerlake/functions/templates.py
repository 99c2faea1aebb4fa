"""Output names from templates, path components within their limits, and small checksums."""

from __future__ import annotations

import binascii
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of UTF-8 that a path component may have.
COMPONENT_BYTES = 200
# Names that a component may not have before its first dot, and a template's tokens: those that fall
# back to the base name, and those that may be empty.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(10)), *(f"LPT{i}" for i in range(10)))
NAMED, OPTIONAL, GIVEN = ("title", "titleId", "serial"), ("region", "console"), ("ext", "basename")
_BRACES = re.compile(r"\{([^}]*)\}")


def truncated(text: Column, most: int = COMPONENT_BYTES) -> Column:
    """The longest beginning of whole characters within `most` bytes."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: F.octet_length(F.substring(text, F.lit(1), k)) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.array_max(fits)))


def component(text: Column) -> Column:
    """A single safe path component: no control characters, separators and forbidden characters replaced, no trailing
    dots or spaces, at most COMPONENT_BYTES long, and marked where the part before its first dot is reserved."""
    safe = F.regexp_replace(F.regexp_replace(text, r"\p{Cc}", ""), r'[<>:"/\\|?*]', "_")
    safe = truncated(F.regexp_replace(safe, r"[. ]+\z", ""))
    head = F.translate(F.substring_index(safe, ".", 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.when(head.isin(*RESERVED), F.concat(safe, F.lit("_"))).otherwise(safe)


def template_column(template: str, tokens: dict[str, Column]) -> Column:
    """The relative path that a template gives each row, with a column for each token; basename is always needed.

    Title, title id and serial fall back to the base name, region and console to nothing; other names in braces stay
    as written. Values can't add folders. Absolute templates are an error; a row is null where a part is `..` or
    where no part is left.
    """
    if re.match(r"[/\\]|[A-Za-z]:", template):
        raise ValueError("a template names a relative path")
    pieces, at = [], 0
    for m in _BRACES.finditer(template):
        value = F.lit(m[0])
        if m[1] in NAMED:
            value = F.coalesce(*([tokens[m[1]].cast("string")] if m[1] in tokens else []), tokens["basename"].cast("string"))
        elif m[1] in OPTIONAL:
            value = F.coalesce(tokens[m[1]].cast("string"), F.lit("")) if m[1] in tokens else F.lit("")
        elif m[1] in GIVEN:
            value = tokens[m[1]].cast("string")
        pieces += [F.lit(template[at : m.start()]), value if value is None or m[1] not in (*NAMED, *OPTIONAL, *GIVEN) else F.translate(value, "/\\", "__")]
        at = m.end()
    parts = F.split(F.concat(*pieces, F.lit(template[at:])), r"[/\\]")
    up = F.exists(parts, lambda x: F.trim(x) == "..")
    safe = F.filter(F.transform(F.filter(parts, lambda x: ~F.trim(x).isin("", ".")), component), lambda x: x != "")
    return F.when(~up & (F.size(safe) > 0), F.array_join(safe, "/"))


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """CRC-16/CCITT-FALSE."""
    return binascii.crc_hqx(data, value)


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")


@F.pandas_udf(T.IntegerType())
def crc16_column(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else crc16(b)).astype("Int32")
