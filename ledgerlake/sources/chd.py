"""CHD images of version 5: the map of hunks, decoded hunks, checks and track digests.

A hunk is stored with one of the four codecs that the header names, as it is, as a copy of an earlier hunk, or in a
parent image. zlib, lzma and zstd, and the CD forms of these, are decoded; hunks of other codecs and of a parent are
errors of their image. Only one hunk, and the map, is held at a time.
"""

from __future__ import annotations

import hashlib
import lzma
import re
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

HEADER = ">8sII4s4s4s4sQQQII20s20s20s"
# What stands in the map of compressed images, and the frames of a CD.
NONE, SELF, PARENT, RLE_SMALL, RLE_LARGE, SELF_0, SELF_1, PARENT_SELF, PARENT_0, PARENT_1 = range(4, 14)
FRAME, SECTOR, SUBCODE, TRACK_PAD = 2448, 2352, 96, 4
SYNC = b"\0" + b"\xff" * 10 + b"\0"
#: Bytes of a sector that an extracted track keeps, by the track's type; others keep the whole sector.
KEPT = {"MODE1": 2048, "MODE2_FORM1": 2048, "MODE2_FORM2": 2324, "MODE2": 2336, "MODE2_FORM_MIX": 2336}


class Header(NamedTuple):
    codecs: tuple[str, ...]
    logical: int
    map_at: int
    meta_at: int
    hunk: int
    unit: int
    raw_sha1: str
    sha1: str
    parent: bool


def header(f) -> Header:
    f.seek(0)
    data = f.read(struct.calcsize(HEADER))
    if len(data) < struct.calcsize(HEADER):
        raise ValueError("the header is cut short")
    magic, _, version, a, b, c, d, logical, map_at, meta_at, hunk, unit, raw, whole, parent = struct.unpack(HEADER, data)
    if magic != b"MComprHD" or version != 5 or not hunk or not unit:
        raise ValueError("no CHD file of version 5")
    return Header(tuple(x.decode("latin-1") if x.strip(b"\0") else "" for x in (a, b, c, d)), logical, map_at, meta_at, hunk, unit, raw.hex(), whole.hex(), any(parent))


def metadata(f, at: int) -> list[tuple[str, int, bytes]]:
    """(tag, flags, content) of the entries, in order."""
    found, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        f.seek(at)
        data = f.read(16)
        if len(data) < 16:
            raise ValueError("a metadata entry is cut short")
        tag, length, after = struct.unpack(">4sIQ", data)
        found.append((tag.decode("latin-1"), length >> 24, f.read(length & 0xFFFFFF)))
        at = after
    return found


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        c <<= 8
        for _ in range(8):
            c = (c << 1) ^ 0x1021 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x1021 from 0xFFFF."""
    crc, table = 0xFFFF, _crc_table()
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b]
    return crc


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def read(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data) + 8:
                raise ValueError("the map is cut short")
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out


def _kinds_reader(bits: _Bits):
    """Reads the Huffman tree of the map's 16 kinds; returns a function that reads one kind."""
    lengths: list[int] = []
    while len(lengths) < 16:
        n, many = bits.read(4), 1
        if n == 1 and (n := bits.read(4)) != 1:
            many = bits.read(4) + 3
        lengths += [n] * many
    if len(lengths) > 16:
        raise ValueError("the map's tree is damaged")
    codes, start = {}, 0
    for n in range(max(lengths), 0, -1):  # the longest codes come first
        for kind in (k for k, x in enumerate(lengths) if x == n):
            codes[n, start] = kind
            start += 1
        start >>= 1

    def one() -> int:
        code = 0
        for n in range(1, 9):
            code = code << 1 | bits.read(1)
            if (kind := codes.get((n, code))) is not None:
                return kind
        raise ValueError("the map's tree has no such code")

    return one


def hunk_map(f, h: Header | None = None) -> list[tuple[int, int, int, int | None]]:
    """(kind, offset, stored length, CRC-16 or None) of each hunk. Kinds are 0 to 3 (a codec), NONE, SELF (offset: the
    hunk that it copies) and PARENT (offset: its unit there)."""
    h = h or header(f)
    count = -(-h.logical // h.hunk)
    f.seek(h.map_at)
    if not h.codecs[0]:
        data = f.read(4 * count)
        if len(data) < 4 * count:
            raise ValueError("the map is cut short")
        return [(NONE, x * h.hunk, h.hunk, None) for x in struct.unpack(f">{count}I", data)]
    head = f.read(16)
    if len(head) < 16:
        raise ValueError("the map is cut short")
    size, place = struct.unpack(">I6s", head[:10])[0], int.from_bytes(head[4:10], "big")
    want, (length_bits, self_bits, parent_bits) = int.from_bytes(head[10:12], "big"), head[12:15]
    bits = _Bits(f.read(size))
    one, kinds, last = _kinds_reader(bits), [], 0
    while len(kinds) < count:
        kind = one()
        if kind == RLE_SMALL:
            kinds += [last] * (3 + one())
        elif kind == RLE_LARGE:
            kinds += [last] * (19 + (one() << 4) + one())
        else:
            last = kind
            kinds.append(kind)
    out, copied, above, per_hunk = [], 0, 0, h.hunk // h.unit
    for k, kind in enumerate(kinds[:count]):
        if kind <= NONE:
            length = h.hunk if kind == NONE else bits.read(length_bits)
            out.append((kind, place, length, bits.read(16)))
            place += length
        elif kind in (SELF, SELF_0, SELF_1):
            copied = bits.read(self_bits) if kind == SELF else copied + (kind == SELF_1)
            out.append((SELF, copied, 0, None))
        elif kind in (PARENT, PARENT_SELF, PARENT_0, PARENT_1):
            above = {PARENT: lambda: bits.read(parent_bits), PARENT_SELF: lambda: k * per_hunk, PARENT_0: lambda: above, PARENT_1: lambda: above + per_hunk}[kind]()
            out.append((PARENT, above, 0, None))
        else:
            raise ValueError(f"hunk {k}: unknown kind {kind}")
    whole = b"".join(struct.pack(">B", kind) + length.to_bytes(3, "big") + at.to_bytes(6, "big") + (crc or 0).to_bytes(2, "big") for kind, at, length, crc in out)
    if crc16(whole) != want:
        raise ValueError("the map's checksum differs")
    return out


def _inflate(codec: str, data: bytes, size: int) -> bytes:
    if codec == "zlib":
        return zlib.decompressobj(-15).decompress(data, size)
    if codec == "lzma":
        try:
            found = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 26}])
            return found.decompress(data, size)
        except lzma.LZMAError as e:
            raise ValueError(str(e)) from e
    if codec == "zstd":
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        except zstandard.ZstdError as e:
            raise ValueError(str(e)) from e
    raise ValueError(f"codec {codec} is not decoded")


# The layout of P and Q parity in a sector: (first byte, columns, rows, step over columns, step over rows).
_PARITY = ((0x81C, 86, 24, 2, 86), (0x8C8, 52, 43, 86, 88))


@lru_cache(maxsize=1)
def _field() -> tuple[np.ndarray, np.ndarray]:
    """Doubling in the field of 256 elements (polynomial 0x11D), and its inverse over x ^ 2x."""
    x = np.arange(256)
    double = ((x << 1) ^ np.where(x & 0x80, 0x11D, 0)).astype(np.uint8)
    back = np.zeros(256, np.uint8)
    back[x ^ double] = x
    return double, back


def with_parity(sector: bytes) -> bytes:
    """A raw sector with its sync pattern and both parities made anew. Sectors of mode 2 count their header as zeros."""
    double, back = _field()
    out = np.frombuffer(bytearray(SYNC + sector[12:]), np.uint8)
    for first, columns, rows, across, down in _PARITY:
        source = out[12:].copy()
        if out[15] == 2:
            source[:4] = 0
        start = (np.arange(columns) >> 1) * across + (np.arange(columns) & 1)
        a = b = np.zeros(columns, np.uint8)
        for r in range(rows):
            value = source[(start + r * down) % (columns * rows)]
            a, b = double[a ^ value], b ^ value
        a = back[double[a] ^ b]
        out[first : first + columns], out[first + columns : first + 2 * columns] = a, a ^ b
    return out.tobytes()


def _cd_hunk(codec: str, data: bytes, size: int) -> bytes:
    """A hunk whose sectors and subcodes are compressed apart; marked sectors get back their sync and parity."""
    frames = size // FRAME
    marks, wide = -(-frames // 8), 2 if size < 65536 else 3
    length = int.from_bytes(data[marks : marks + wide], "big")
    body = data[marks + wide :]
    sectors = _inflate(codec, body[:length], frames * SECTOR)
    codes = _inflate("zlib" if codec == "lzma" else codec, body[length:], frames * SUBCODE)
    if len(sectors) < frames * SECTOR or len(codes) < frames * SUBCODE:
        raise ValueError("a hunk is cut short")
    out = []
    for k in range(frames):
        sector = sectors[k * SECTOR : (k + 1) * SECTOR]
        out += [with_parity(sector) if data[k >> 3] >> (k & 7) & 1 else sector, codes[k * SUBCODE : (k + 1) * SUBCODE]]
    return b"".join(out)


_CD = {"cdzl": "zlib", "cdlz": "lzma", "cdzs": "zstd"}


def hunks(f, h: Header | None = None):
    """Decoded hunks in order; the last one ends with the image. A checksum that differs is an error."""
    h = h or header(f)
    table = hunk_map(f, h)
    for k in range(len(table)):
        source = k
        while table[source][0] == SELF:
            if table[source][1] >= source:
                raise ValueError(f"hunk {k}: copies a later hunk")
            source = table[source][1]
        kind, at, length, crc = table[source]
        if kind == PARENT:
            raise ValueError(f"hunk {k}: stands in a parent image")
        if kind == NONE and crc is None and not at:
            data = b"\0" * h.hunk
        else:
            f.seek(at)
            data = f.read(length)
            if kind != NONE:
                codec = h.codecs[kind]
                data = _cd_hunk(_CD[codec], data, h.hunk) if codec in _CD else _inflate(codec, data, h.hunk)
            if len(data) < h.hunk:
                raise ValueError(f"hunk {k}: {len(data)} of {h.hunk} bytes")
            if crc is not None and crc16(data) != crc:
                raise ValueError(f"hunk {k}: checksum differs")
        yield data[: h.logical - k * h.hunk]


def whole_sha1(raw_sha1: str, entries: list[tuple[str, int, bytes]]) -> str:
    """The digest of an image with its metadata: that of the content, then tags and digests of marked entries, sorted."""
    marked = sorted(tag.encode("latin-1") + hashlib.sha1(content).digest() for tag, flags, content in entries if flags & 1)
    return hashlib.sha1(bytes.fromhex(raw_sha1) + b"".join(marked)).hexdigest()


def verified(f) -> tuple[str, str, bool, bool]:
    """(SHA-1 of the content, SHA-1 with metadata, whether each is the header's)."""
    h, content = header(f), hashlib.sha1()
    for data in hunks(f, h):
        content.update(data)
    raw = content.hexdigest()
    whole = whole_sha1(raw, metadata(f, h.meta_at))
    return raw, whole, raw == h.raw_sha1, whole == h.sha1


_TRACK = re.compile(r"(\w+):(\S+)")


def track_list(entries: list[tuple[str, int, bytes]]) -> list[tuple[int, str, int]]:
    """(number, type, frames) of a CD's tracks, by number."""
    found = []
    for tag, _, content in entries:
        if tag in ("CHT2", "CHTR"):
            has = dict(_TRACK.findall(content.rstrip(b"\0").decode("latin-1")))
            found.append((int(has["TRACK"]), has["TYPE"], int(has["FRAMES"])))
    return sorted(found)


def _frames(f, h: Header):
    """Frames in order; a hunk need not end with one."""
    rest = b""
    for data in hunks(f, h):
        rest += data
        for k in range(0, len(rest) - FRAME + 1, FRAME):
            yield rest[k : k + FRAME]
        rest = rest[len(rest) // FRAME * FRAME :]


def track_streams(f):
    """(number, type, blocks) for each track as it would be extracted; blocks must be used up before the next track.

    Audio is stored with swapped bytes. Tracks begin at whole groups of four frames."""
    h = header(f)
    tracks = track_list(metadata(f, h.meta_at))
    if not tracks:
        raise ValueError("no tracks")
    frames = _frames(f, h)

    def blocks(kind: str, count: int):
        for _ in range(count):
            data = next(frames, None)
            if data is None:
                raise ValueError("a track is cut short")
            data = data[: KEPT.get(kind, SECTOR)]
            yield np.frombuffer(data, np.uint16).byteswap().tobytes() if kind == "AUDIO" else data

    for number, kind, count in tracks:
        yield number, kind, blocks(kind, count)
        for _ in range(-count % TRACK_PAD):
            next(frames, None)
