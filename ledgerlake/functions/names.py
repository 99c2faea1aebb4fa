"""File names: parts, junk rules, safe names, disc tokens, derived paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that operating systems and storage devices leave behind, and names that Windows reserves.
JUNK_FILES = (".DS_Store", "Thumbs.db", "desktop.ini", ".localized")
JUNK_DIRS = ("@eaDir", ".@__thumb", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", ".AppleDouble", ".AppleDB", ".AppleDesktop", "#recycle", "@Recently-Snapshot", "lost+found")
JUNK_DIRS_ANY_CASE = ("$recycle.bin", "recycler", "system volume information")
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-case extension without its dot; empty where there is none. A leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.lit("")), name)


def has_extension(path: Column, wanted: tuple[str, ...]) -> Column:
    return extension(path).isin([x.lower().lstrip(".") for x in wanted])


def is_junk_file(name: str) -> bool:
    return name.startswith("._") or name in JUNK_FILES


def is_junk_dir(name: str) -> bool:
    return name in JUNK_DIRS or ascii_lower(name) in JUNK_DIRS_ANY_CASE


def is_junk(path: Column) -> Column:
    """Files that operating systems leave behind, or any file below such a folder. Case counts, but for three folders."""
    parts = F.split(path, r"[/\\]")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    inside = F.exists(folders, lambda d: d.isin(*JUNK_DIRS) | folded(d).isin(*JUNK_DIRS_ANY_CASE))
    name = basename(path)
    return name.startswith("._") | name.isin(*JUNK_FILES) | inside


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """ASCII letters in lower case; all others stay."""
    return F.translate(text, _UPPER, _LOWER)


def ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def depth(relative: Column) -> Column:
    """1 for files directly in the root."""
    return F.size(F.split(relative, r"[/\\]"))


def sanitized_stem(name: Column) -> Column:
    """A stem that every file system takes: forbidden characters replaced, trailing dots and spaces off, reserved
    names marked. Control characters stay; a stem of nothing else comes out empty, and its file is then left alone."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[. ]+\z", "")
    return F.when(folded(safe).isin(*RESERVED), F.concat(safe, F.lit("_"))).otherwise(safe)


def collision_key(path: Column) -> Column:
    """Paths that name the same file on a system that ignores ASCII case share it: either separator, once, without
    `.` parts in between."""
    plain = F.regexp_replace(F.regexp_replace(folded(path), r"[/\\]+", "/"), r"(^|/)(\./)+", "$1")
    return F.regexp_replace(F.regexp_replace(plain, r"(?<=/)\.\z", ""), r"(?<=.)/\z", "")


# Fixed value: a disc token is the word disc, white space and a number, and perhaps "of" and another.
_NUMBER = r"disc\s+\+?0*([0-9]{1,10})(?:\s+of\s+\+?[0-9]{1,10})?\s*"
#: The right-most in parentheses anywhere, or one without that ends the name, at its start or after white space.
ENCLOSED, ENDING = rf"(?is)^(.*)\(\s*{_NUMBER}\)(.*)\z", rf"(?is)^(|.*\s){_NUMBER}\z"
_MOST = (1 << 32) - 1


def disc_parts(stem_: Column) -> Column:
    """Base title and disc number (base, disc); a name without a token is its own base with disc 0."""

    def part(pattern, k):
        return F.regexp_extract(stem_, pattern, k)

    def number(pattern):
        n = F.nullif(part(pattern, 2), F.lit("")).cast("long")
        return F.when(n <= _MOST, n)

    left, right = F.regexp_replace(part(ENCLOSED, 1), r"(?U)\s+\z", ""), F.regexp_replace(part(ENCLOSED, 3), r"(?U)^\s+", "")
    around = F.when(left == "", F.regexp_replace(right, r"(?U)\s+\z", "")).when(right == "", F.regexp_replace(left, r"(?U)^\s+", "")).otherwise(F.concat_ws(" ", left, right))
    ending = F.regexp_replace(part(ENDING, 1), r"(?U)\s+\z", "")
    one, two = number(ENCLOSED), number(ENDING)
    return F.struct(F.when(one.isNotNull(), around).when(two.isNotNull(), ending).otherwise(stem_).alias("base"), F.coalesce(one, two, F.lit(0).cast("long")).alias("disc"))


def with_extension(path: Column, ext: str) -> Column:
    """The path with another extension (added where it has none)."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit("." + ext))


# What an input becomes when it is packed or unpacked.
PACKED = {"iso": "rvz", "gcm": "rvz", "wbfs": "rvz", "nsp": "nsz", "xci": "xcz", "nca": "ncz", "cia": "zcia", "cci": "zcci", "cxi": "zcxi", "3dsx": "z3dsx", "wud": "wua", "wux": "wua", "cue": "chd"}
UNPACKED = {"rvz": "iso", "nsz": "nsp", "xcz": "xci", "ncz": "nca", "zcia": "cia", "zcci": "cci", "zcxi": "cxi", "z3dsx": "3dsx", "cso": "iso", "zso": "iso", "dax": "iso", "gcz": "iso", "wia": "iso"}


def derived_path(path: Column, packing: bool = True) -> Column:
    """The output path of a conversion; null where the extension has none."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for a, b in (PACKED if packing else UNPACKED).items():
        out = F.when(ext == a, with_extension(path, b)).otherwise(out)
    return out


def place_in(path: Column, folder: str, root: str | None = None) -> Column:
    """The path in another folder: flat, or mirrored below the part that root names."""
    rest = basename(path) if root is None else F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    return F.concat(F.lit(folder.rstrip("/") + "/"), rest)


# What the extension of an input says about the stream inside.
INNER_KINDS = {"rvz": "rvz", "wbfs": "wbfs", "cso": "cso_zso", "zso": "cso_zso", "z3ds": "z3ds", "zcia": "z3ds", "zcci": "z3ds", "zcxi": "z3ds", "z3dsx": "z3ds", "chd": "chd_tracks", "cue": "cue_set", "nsz": "unsupported_compressed", "xcz": "unsupported_compressed"}


def inner_kind(path: Column) -> Column:
    """What has to be decoded before a file's content can be digested; raw for all other extensions."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in INNER_KINDS.items() for x in pair))[extension(path)], F.lit("raw"))


def rereads_cheaply(path: Column, sniffed: Column) -> Column:
    """Whether a second pass of digests only reads the file again: it is raw and its head (the format `sniff` names)
    is no older container."""
    return (inner_kind(path) == "raw") & ~F.coalesce(sniffed.isin("gcz", "wia", "wbfs", "nkit"), F.lit(False))


def tree_order(path: Column) -> Column:
    """What sorts paths as a case-insensitive tree of names does: part by part, ASCII case aside, prefixes first."""
    return F.transform(F.split(path, "/"), folded)
