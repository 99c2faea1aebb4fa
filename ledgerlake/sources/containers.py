"""Indices of disc and archive containers as tables, and their decoded content.

Only headers and index tables are read to list a container. Content is decoded block by block, so a task
holds one block at a time. Formats are read as their public descriptions state.
"""

from __future__ import annotations

import io
import os
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlake.functions.names import is_junk_file
from ledgerlake.schemas import BLOCK, MEMBER
from ledgerlake.sources import chd
from ledgerlake.sources.files import digest_stream

# First bytes and sizes of the formats.
MAGIC = {
    b"CISO": "cso", b"ZISO": "zso", b"DAX\0": "dax", b"MComprHD": "chd", b"\x01\xc0\x0b\xb1": "gcz", b"WIA\x01": "wia", b"RVZ\x01": "rvz",
    b"WBFS": "wbfs", b"WUX0": "wux", b"PFS0": "nsp", b"PK\x03\x04": "zip", b"7z\xbc\xaf\x27\x1c": "7z", b"Rar!": "rar", b"Z3DS": "z3ds",
}
DAX_BLOCK = 8192
SECTOR = 2048


def sniff(head: bytes) -> str | None:
    """The format that the first bytes name; extensions don't count. HFS0 sits in a cartridge image at 0x100."""
    for magic, kind in MAGIC.items():
        if head.startswith(magic):
            return kind
    return "xci" if head[0x100:0x104] == b"HEAD" else None


#: Sectors of a CD at most, and bytes of a root folder that are read.
CD_SECTORS, ROOT_BYTES = 452_849, 1 << 20


def disc_kind(f) -> str | None:
    """psp, ps1, ps2_cd or ps2_dvd by the volume descriptor and root folder of an ISO 9660 image with sectors of 2,048
    bytes; None for others, damaged ones included.

    The system id or a PSP folder of the root says psp. SYSTEM.CNF says ps2 by BOOT2 and ps1 by BOOT; ps2 is a dvd
    beyond the sectors of a CD, by the descriptor or the image's size, whichever is more."""
    d = _sector_bytes(f, 16, SECTOR)
    if len(d) < SECTOR or d[0] != 1 or d[1:6] != b"CD001":
        return None
    if b"PSP GAME" in d[8:40]:
        return "psp"
    sectors = max(struct.unpack_from("<I", d, 80)[0], f.seek(0, 2) // SECTOR)
    root, size = struct.unpack_from("<I", d, 158)[0], min(struct.unpack_from("<I", d, 166)[0], ROOT_BYTES)
    entries, found, at = _sector_bytes(f, root, size), {}, 0
    if len(entries) < size:
        return None
    while at < len(entries):
        length = entries[at]
        if not length:  # records never cross sectors
            at = (at // SECTOR + 1) * SECTOR
            continue
        record = entries[at : at + length]
        if len(record) >= 34:
            name = record[33 : 33 + record[32]].split(b";")[0].upper()
            found[name] = struct.unpack_from("<I", record, 2)[0], struct.unpack_from("<I", record, 10)[0]
        at += length
    if b"PSP_GAME" in found or b"UMD_DATA.BIN" in found:
        return "psp"
    if b"SYSTEM.CNF" in found:
        at, size = found[b"SYSTEM.CNF"]
        text = _sector_bytes(f, at, min(size, SECTOR))
        if b"BOOT2" in text:
            return "ps2_dvd" if sectors > CD_SECTORS else "ps2_cd"
        if b"BOOT" in text:
            return "ps1"
    return None


def _sector_bytes(f, sector: int, size: int) -> bytes:
    f.seek(sector * SECTOR)
    return f.read(size)


def _unpack(f, fmt: str, at: int | None = None):
    if at is not None:
        f.seek(at)
    n = struct.calcsize(fmt)
    data = f.read(n)
    if len(data) < n:
        raise ValueError("the index is cut short")
    return struct.unpack(fmt, data)


class Blocks:
    """A container's block table: (offset, stored length, raw, expected length) for each block."""

    def __init__(self, kind: str, size: int, table: list[tuple[int, int, bool, int]], checks: list[int] | None = None):
        self.kind, self.size, self.table, self.checks = kind, size, table, checks

    def read(self, f):
        """Decoded blocks in order."""
        for k, (offset, stored, raw, expected) in enumerate(self.table):
            f.seek(offset)
            data = f.read(stored)
            if self.checks is not None and zlib.adler32(data) != self.checks[k]:
                raise ValueError(f"block {k}: checksum differs")
            if not raw:
                if self.kind == "z3ds":
                    import zstandard

                    try:
                        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=expected)
                    except zstandard.ZstdError as e:
                        raise ValueError(f"block {k}: {e}") from e
                elif self.kind == "zso":
                    data = pa.Codec("lz4_raw").decompress(data, expected).to_pybytes()
                else:
                    data = zlib.decompressobj(-15 if self.kind == "cso" else 15).decompress(data, expected)
            if len(data) < expected:
                raise ValueError(f"block {k}: {len(data)} of {expected} bytes")
            yield data[:expected]


def open_blocks(f) -> Blocks:
    """The block table of a CSO, ZSO, DAX, GCZ, WUX, CHD or Z3DS file."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(0)
    kind = sniff(f.read(0x200))
    if kind in ("cso", "zso"):
        _, _, total, block, _, align = _unpack(f, "<4sIQIBB", 0)
        if not block or block & (block - 1):
            raise ValueError("block size is no power of two")
        n = -(-total // block)
        index = _unpack(f, f"<{n + 1}I", 24)
        place = [(x & 0x7FFFFFFF) << align for x in index]
        if any(a > b for a, b in zip(place, place[1:])) or place[-1] > end:
            raise ValueError("offsets fall or leave the file")
        size = [min(block, total - k * block) for k in range(n)]
        raw = [bool(x >> 31) for x in index[:n]]
        return Blocks(kind, total, [(place[k], size[k] if raw[k] else place[k + 1] - place[k], raw[k], size[k]) for k in range(n)])
    if kind == "dax":
        _, total, version, areas = _unpack(f, "<4sIII", 0)
        n = -(-total // DAX_BLOCK)
        place, stored = _unpack(f, f"<{n}I", 32), _unpack(f, f"<{n}H", 32 + 4 * n)
        plain = set()
        if version >= 1:
            for k in range(areas):
                start, count = _unpack(f, "<II", 32 + 6 * n + 8 * k)
                plain.update(range(start, start + count))
        size = [min(DAX_BLOCK, total - k * DAX_BLOCK) for k in range(n)]
        return Blocks(kind, total, [(place[k], size[k] if k in plain else stored[k], k in plain, size[k]) for k in range(n)])
    if kind == "gcz":
        _, _, packed, total, block, n = _unpack(f, "<IIQQII", 0)
        index, checks = _unpack(f, f"<{n}Q", 32), list(_unpack(f, f"<{n}I", 32 + 8 * n))
        base = 32 + 12 * n
        place = [x & ~(1 << 63) for x in index] + [packed]
        return Blocks(kind, total, [(base + place[k], place[k + 1] - place[k], bool(index[k] >> 63), min(block, total - k * block)) for k in range(n)], checks)
    if kind == "wux":
        _, _, sector, _, total = _unpack(f, "<4sIIIQ", 0)
        n = -(-total // sector)
        index = _unpack(f, f"<{n}I", 32)
        base = -(-(32 + 4 * n) // sector) * sector
        return Blocks(kind, total, [(base + i * sector, min(sector, total - k * sector), True, min(sector, total - k * sector)) for k, i in enumerate(index)])
    if kind == "chd":
        return ChdBlocks(f)
    if kind == "z3ds":
        return seekable_blocks(f)
    raise ValueError(f"no block container: {kind}")


class ChdBlocks(Blocks):
    """The hunks of a CHD; a copy of another hunk has that one's place."""

    def __init__(self, f):
        h, table = chd.header(f), []
        for k, (kind, at, length, _) in enumerate(chd.hunk_map(f, h)):
            size = min(h.hunk, h.logical - k * h.hunk)
            if kind == chd.SELF:
                if at >= k:
                    raise ValueError(f"hunk {k}: copies a later hunk")
                table.append((*table[at][:3], size))
            else:
                table.append((None if kind == chd.PARENT else at, length, kind == chd.NONE, size))
        super().__init__("chd", h.logical, table)

    def read(self, f):
        return chd.hunks(f)


def seekable_blocks(f) -> Blocks:
    """The frames of a Z3DS file, whose payload is a seekable zstd stream: a table of frame lengths ends it."""
    _, _, _, _, head, extra, packed, total = _unpack(f, "<4s4sBBHIQQ", 0)
    base = head + extra
    n, how, magic = _unpack(f, "<IBI", base + packed - 9)
    wide = 12 if how & 0x80 else 8
    if magic != 0x8F92EAB1 or n * wide + 17 > packed:
        raise ValueError("no table of frames")
    table, at = [], base
    for k in range(n):
        stored, size = _unpack(f, "<II", base + packed - 9 - (n - k) * wide)
        table.append((at, stored, False, size))
        at += stored
    if sum(size for *_, size in table) != total:
        raise ValueError("frames do not add up to the image")
    return Blocks("z3ds", total, table)


def wbfs_slots(f) -> list[tuple[int, int]]:
    """(block of the disc, block of the file) for the used blocks of a WBFS file's first disc."""
    magic, _, hd, wb = _unpack(f, ">4sIBB", 0)
    if magic != b"WBFS":
        raise ValueError("no WBFS file")
    n = (143432 * 2 << 15) >> wb
    table = _unpack(f, f">{n}H", (1 << hd) + 0x100)
    return [(k, x) for k, x in enumerate(table) if x]


def _partition(f, at: int, label: str):
    """Members of a PFS0 or HFS0 partition at an offset, offsets from the start of the file."""
    magic, n, strings, _ = _unpack(f, "<4sIII", at)
    wide = {b"PFS0": 24, b"HFS0": 64}.get(magic)
    if wide is None:
        raise ValueError("no partition header")
    entries = [_unpack(f, "<QQI", at + 16 + wide * k) for k in range(n)]
    f.seek(at + 16 + wide * n)
    table = f.read(strings)
    base = at + 16 + wide * n + strings
    return [(label, table[name : table.index(b"\0", name)].decode("utf-8", "replace"), base + offset, size, None) for offset, size, name in entries]


def members(path: str, f=None) -> list[tuple]:
    """(partition, name, offset, size, crc32) of a container's files, by name; junk and nested archives out
    of archives."""
    with f or open(path, "rb") as f:
        head = f.read(0x200)
        kind = sniff(head)
        if kind == "nsp":
            return _partition(f, 0, "")
        if kind == "xci":
            (root,) = _unpack(f, "<Q", 0x130)
            out = []
            for _, name, at, _, _ in _partition(f, root, ""):
                out += _partition(f, at, name)
            return out
        f.seek(0)
        found = []
        if kind == "zip":
            with zipfile.ZipFile(f) as z:
                found = [("", i.filename, i.header_offset, i.file_size, f"{i.CRC:08x}") for i in z.infolist() if not i.is_dir()]
        elif tarfile.is_tarfile(f):
            f.seek(0)
            with tarfile.open(fileobj=f) as t:
                found = [("", m.name, m.offset_data, m.size, None) for m in t if m.isfile()]
        else:
            raise ValueError("no container that lists members")
        nested = (".zip", ".7z", ".rar", ".tar", ".gz", ".tgz")
        return sorted(x for x in found if not is_junk_file(os.path.basename(x[1])) and not x[1].lower().endswith(nested))


def _mapped(df: DataFrame, one, schema: T.StructType) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pd.DataFrame([r for p in batch["path"] for r in one(p)], columns=schema.names)

    return df.select("path").mapInPandas(run, schema)


#: What a damaged or unreadable container raises.
DAMAGED = (OSError, ValueError, KeyError, IndexError, EOFError, struct.error, zlib.error, zipfile.BadZipFile, tarfile.TarError, pa.ArrowException, UnicodeError)


def _guarded(one, width: int):
    """one(path) with a column error: a container that can't be read gives one row of nulls with its error."""

    def run(path):
        try:
            return [(*row, None) for row in one(path)]
        except DAMAGED as e:
            return [(path, *[None] * (width - 1), f"{type(e).__name__}: {e}")]

    return run


def _with_error(schema: T.StructType) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField("error", T.StringType())])


def container_blocks(files: DataFrame, errors: bool = False) -> DataFrame:
    """A row for each block of each container. A damaged container fails alone: it has no blocks, or with `errors`
    one row that says why."""

    def one(path):
        with open(path, "rb") as f:
            return [(path, k, a, n, raw, size) for k, (a, n, raw, size) in enumerate(open_blocks(f).table)]

    got = _mapped(files, _guarded(one, len(BLOCK.fields)), _with_error(BLOCK))
    return got if errors else got.where("error is null").drop("error")


def container_members(files: DataFrame, errors: bool = False) -> DataFrame:
    """A row for each file in each archive or partition container; `errors` as in `container_blocks`."""
    got = _mapped(files, _guarded(lambda path: [(path, *m) for m in members(path)], len(MEMBER.fields)), _with_error(MEMBER))
    return got if errors else got.where("error is null").drop("error")


DECODED = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("kind", T.StringType()), ("crc32", T.StringType()), ("sha1", T.StringType()), ("md5", T.StringType()), ("sha256", T.StringType()), ("size_bytes", T.LongType()), ("error", T.StringType()))])


def digest_decoded(files: DataFrame, algorithms: tuple[str, ...] = ("crc32", "sha1")) -> DataFrame:
    """Digests of what containers hold, equal to those of the plain image. A damaged container fails alone."""

    def one(path):
        kind, got, error = None, {}, None
        try:
            with open(path, "rb") as f:
                blocks = open_blocks(f)
                kind = blocks.kind
                it = blocks.read(f)
                got = digest_stream(lambda _: next(it, b""), algorithms)
        except DAMAGED as e:
            error = str(e)
        return [(path, kind, got.get("crc32"), got.get("sha1"), got.get("md5"), got.get("sha256"), got.get("size_bytes"), error)]

    return _mapped(files, one, DECODED)


CHD = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("version", T.IntegerType()), ("codecs", T.ArrayType(T.StringType())), ("logical_bytes", T.LongType()), ("hunk_bytes", T.LongType()), ("unit_bytes", T.LongType()), ("raw_sha1", T.StringType()), ("sha1", T.StringType()), ("has_parent", T.BooleanType()), ("metadata", T.ArrayType(T.StringType())))])


def chd_info(files: DataFrame, errors: bool = False) -> DataFrame:
    """Headers and metadata entries (tag and text) of CHD files, version 5; `errors` as in `container_blocks`."""

    def one(path):
        with open(path, "rb") as f:
            h = chd.header(f)
            found = [f"{tag}:{content.rstrip(b"\0").decode('utf-8', 'replace')}" for tag, _, content in chd.metadata(f, h.meta_at)]
            return [(path, 5, [c for c in h.codecs if c], h.logical, h.hunk, h.unit, h.raw_sha1, h.sha1, h.parent, found)]

    got = _mapped(files, _guarded(one, len(CHD.fields)), _with_error(CHD))
    return got if errors else got.where("error is null").drop("error")


def quick_crc(files: DataFrame) -> DataFrame:
    """(path, name, size_bytes, crc32) of zip archives with one member that is no container itself: their
    CRC32 stands in the directory, so nothing is decoded."""

    def one(path):
        try:
            with zipfile.ZipFile(path) as z:
                own = [i for i in z.infolist() if not i.is_dir() and not is_junk_file(os.path.basename(i.filename))]
                if len(own) == 1:
                    with z.open(own[0]) as m:
                        head = io.BytesIO(m.read(0x200)).getvalue()
                    if sniff(head) is None:
                        return [(path, own[0].filename, own[0].file_size, f"{own[0].CRC:08x}")]
        except (OSError, zipfile.BadZipFile):
            pass
        return []

    return _mapped(files, one, T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("name", T.StringType()), ("size_bytes", T.LongType()), ("crc32", T.StringType()))]))
