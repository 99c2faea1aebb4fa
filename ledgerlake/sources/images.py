"""Checks and digests of disc images as tables: CHD content, CHD tracks, and the header digests of RVZ and WIA files."""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlake.schemas import DIGEST
from ledgerlake.sources import chd
from ledgerlake.sources.containers import _guarded, _mapped, _with_error, sniff


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _B = T.StringType(), T.BooleanType()
VERIFIED = _struct(path=_S, raw_sha1=_S, sha1=_S, raw_ok=_B, sha1_ok=_B, ok=_B)
STRUCTURE = _struct(path=_S, kind=_S, head_ok=_B, disc_ok=_B, parts_ok=_B, ok=_B)


def chd_verify(files: DataFrame) -> DataFrame:
    """(path, raw_sha1, sha1, raw_ok, sha1_ok, ok, error): whether decoded content and metadata have the digests of
    the header. An image that can't be decoded has nulls and its error."""

    def one(path):
        with open(path, "rb") as f:
            raw, whole, raw_ok, sha1_ok = chd.verified(f)
        return [(path, raw, whole, raw_ok, sha1_ok, raw_ok and sha1_ok)]

    return _mapped(files, _guarded(one, len(VERIFIED.fields)), _with_error(VERIFIED))


def chd_track_digests(files: DataFrame, algorithms: tuple[str, ...] = ("crc32", "sha1")) -> DataFrame:
    """Digests of each track of a CHD (scope track) and of all tracks in a row (scope whole), in one pass, with a
    column error. Digests that are not asked for are null. An image that can't be read has one row with its error."""

    class Sums:
        def __init__(self):
            self.tools, self.crc, self.size = {a: hashlib.new(a) for a in algorithms if a != "crc32"}, 0, 0

        def update(self, data):
            self.size += len(data)
            if "crc32" in algorithms:
                self.crc = zlib.crc32(data, self.crc)
            for t in self.tools.values():
                t.update(data)

        def row(self, path, scope, number, kind):
            got = {a: t.hexdigest() for a, t in self.tools.items()} | ({"crc32": f"{self.crc:08x}"} if "crc32" in algorithms else {})
            return (path, scope, number, kind, *(got.get(a) for a in ("crc32", "sha1", "md5", "sha256")), self.size)

    def one(path):
        out, whole = [], Sums()
        with open(path, "rb") as f:
            for number, kind, blocks in chd.track_streams(f):
                track = Sums()
                for data in blocks:
                    track.update(data)
                    whole.update(data)
                out.append(track.row(path, "track", number, kind))
        return [*out, whole.row(path, "whole", None, None)]

    return _mapped(files, _guarded(one, len(DIGEST.fields)), _with_error(DIGEST))


def structure_verify(files: DataFrame) -> DataFrame:
    """(path, kind, head_ok, disc_ok, parts_ok, ok, error) of RVZ and WIA files: whether the file header, the disc header and
    the table of partitions have their stored SHA-1. Nothing is decoded."""

    def one(path):
        with open(path, "rb") as f:
            kind = sniff(f.read(0x200))
            if kind not in ("rvz", "wia"):
                raise ValueError("no RVZ or WIA file")
            f.seek(0)
            head = f.read(0x48)
            if len(head) < 0x48:
                raise ValueError("the header is cut short")
            (size,) = struct.unpack_from(">I", head, 12)
            disc = f.read(size)
            if len(disc) < size or size < 0xB4:
                raise ValueError("the disc header is cut short")
            parts, entry, at = struct.unpack_from(">IIQ", disc, 0x90)
            f.seek(at)
            table = f.read(parts * entry)
        good = [hashlib.sha1(data).digest() == want for data, want in ((head[:0x34], head[0x34:0x48]), (disc, head[0x10:0x24]), (table, disc[0xA0:0xB4]))]
        return [(path, kind, *good, all(good))]

    return _mapped(files, _guarded(one, len(STRUCTURE.fields)), _with_error(STRUCTURE))
