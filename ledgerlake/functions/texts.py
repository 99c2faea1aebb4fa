"""Escapes and human-readable amounts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_escape(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def html_escape(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def csv_field(text: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end; null is empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def fixed(x: Column, digits: int) -> Column:
    """As C's %.2f, with one to four decimals: the double's exact value counts, halves go to the even digit. `format_string`
    rounds the shortest decimal that reads as the double, and halves up: 2.565, a double just below that, becomes 2.57.
    `format_number` knows the exact value, but Java's takes the least double that reads as a half (0.0005, which is above it)
    for less, and a decimal shorter than asked for as it is, as those of large numbers are: these are rounded as decimals.
    From 2^63 on, zeros follow the shortest decimal's digits."""
    size, whole = F.abs(x), x.cast("long")
    usual = F.call_function("format_number", F.when(size == 0.5 / 10**digits, x * 1.5).otherwise(x), F.lit("0." + "0" * digits))
    large = F.bround(whole.cast("decimal(19,0)") + (x - whole).cast("decimal(14,13)"), digits).cast("string")
    return F.when(size < 2.0**39, usual).when(size < 2.0**63, large).when(size >= 2.0**63, F.replace(F.lower(F.format_string(f"%.{digits}f", x)), F.lit("infinity"), F.lit("inf")))


def format_bytes(n: Column) -> Column:
    """Bytes whole, larger amounts in binary units with one decimal."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << 10 * k, F.concat(fixed(n / float(1 << 10 * k), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def ratio_pct(before: Column, after: Column) -> Column:
    """Percent saved, one decimal, halves away from zero; null where nothing went in."""
    x = (1 - after / before) * 1000
    return F.when(before > 0, F.signum(x) * F.floor(F.abs(x) + 0.5) / 10)


def size_delta(ours: Column, theirs: Column) -> Column:
    """The difference in bytes with thousands marks, and in percent of theirs (zero where theirs is nothing)."""
    d = (ours - theirs).cast("long")
    share = F.when(theirs == 0, F.lit(0.0)).otherwise(F.try_divide(d * 100.0, theirs))
    plus = F.when(d >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.format_string("%s%s B (%s%s %%)", plus, F.format_number(d, 0), plus, fixed(share, 4))


def delta_ratio(ours: Column, theirs: Column) -> Column:
    """Our time as a multiple of theirs, with the speed-up where ours is shorter (inf where it is zero); n/a where theirs is
    zero, null where one is unknown."""
    speedup = F.when(ours == 0, "inf").otherwise(fixed(F.try_divide(theirs, ours), 2))
    faster = F.when(ours < theirs, F.concat(F.lit(" ("), speedup, F.lit("x faster)"))).otherwise("")
    return F.when(theirs == 0, "n/a").otherwise(F.concat(fixed(F.try_divide(ours, theirs), 2), F.lit("x"), faster))


def human_size(n: Column) -> Column:
    """Whole KB and MB, GB with one decimal, by powers of 1,024."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in ((10, "KB"), (20, "MB")):
        out = F.when(n >= 1 << k, F.format_string(f"%.0f {unit}", F.bround(n / float(1 << k), 0))).otherwise(out)
    return F.when(n >= 1 << 30, F.concat(fixed(n / float(1 << 30), 1), F.lit(" GB"))).otherwise(out)


def format_seconds(seconds: Column) -> Column:
    return F.concat(fixed(seconds, 3), F.lit(" s"))


def format_duration(ms: Column) -> Column:
    """Minutes and seconds from a minute on, else seconds with tenths that are cut off."""
    ms = ms.cast("long")
    s = _div(ms, 1000)
    return F.when(s >= 60, F.format_string("%dm%02ds", _div(s, 60), s % 60)).otherwise(F.concat(s, F.lit("."), _div(ms % 1000, 100), F.lit("s")))


def _div(a: Column, b: int) -> Column:
    """Whole quotient of whole numbers; a quotient of doubles is off from 2^53 on."""
    return F.call_function("div", a, F.lit(b))


def count_prefix(ok: Column, failed: Column, skipped: Column) -> Column:
    """An unknown number of ok files makes the text null; unknown others are left out."""
    others = F.concat(*(F.when(n > 0, F.concat(F.lit(", "), n, F.lit(f" {what}"))).otherwise("") for n, what in ((failed, "failed"), (skipped, "skipped"))))
    return F.concat(ok, F.when((failed > 0) | (skipped > 0), F.concat(F.lit(" ok"), others)).otherwise(" files"))


def summary_line(direction: Column, ok: Column, failed: Column, skipped: Column, size_in: Column, size_out: Column, ms: Column) -> Column:
    """The last line of a batch: how many files, and by direction (count_only, dry_run, compress, decompress, convert)
    what became of their size."""
    prefix, took = count_prefix(ok, failed, skipped), format_duration(ms)
    sizes = F.concat(prefix, F.lit(": "), format_bytes(size_in), F.lit(" -> "), format_bytes(size_out))

    def share(part):
        return F.format_string(" (%d%%)", F.floor(F.try_divide(part * 100.0, size_in) + 0.5))

    saved, grew = size_in - size_out, F.greatest(size_out - size_in, F.lit(0))
    packed = F.when((size_in == 0) | (saved <= 0), F.concat(sizes, F.lit(", no space saved"))).otherwise(F.concat(sizes, F.lit(", saved "), format_bytes(saved), share(saved)))
    unpacked = F.when(size_in == 0, sizes).otherwise(F.concat(sizes, F.lit(", expanded by "), format_bytes(grew), share(grew)))
    body = F.when(direction == "count_only", prefix).when(direction == "dry_run", F.concat(F.lit("Dry run: "), prefix, F.lit(" planned"))).when(direction == "compress", packed).when(direction == "decompress", unpacked).otherwise(sizes)
    return F.concat(body, F.lit(" in "), took)


def msf(frames: Column) -> Column:
    """Minutes, seconds and frames at 75 a second; minutes wrap at 256."""
    return F.format_string("%02d:%02d:%02d", F.floor(frames / 4500) % 256, F.floor(frames / 75) % 60, frames % 75)


def frames(text: Column) -> Column:
    """Frames of mm:ss:ff; null for other texts."""
    part = [F.nullif(F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+)\s*$", k), F.lit("")).cast("long") for k in (1, 2, 3)]
    return (part[0] * 60 + part[1]) * 75 + part[2]


def aligned_up(x: Column, step: int) -> Column:
    return (F.ceil(x / step) * step).cast("long")


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def preferred(values: Column, languages: tuple[str, ...] = ("en", "en_us", "en_gb")) -> Column:
    """Of (lang, text) pairs, the first in a preferred language, else the first with any text."""
    kept = F.filter(values, lambda v: F.length(v["text"]) > 0)
    picks = []
    for lang in languages:
        picks.append(F.get(F.filter(kept, _speaks(lang)), F.lit(0))["text"])
    return F.coalesce(*picks, F.get(kept, F.lit(0))["text"])


def _speaks(lang: str):
    return lambda v: v["lang"] == lang
