"""Directory trees as tables, and digests of files read in chunks."""

from __future__ import annotations

import hashlib
import os
import re
import time
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlake.functions.names import is_junk_dir, is_junk_file
from ledgerlake.schemas import FILE, HASH_REPORT

CHUNK = 4 << 20


#: Folders that a scan is split into at least, where there are as many, and levels that are listed for that.
SPLITS, LISTED = 256, 4


class _Folder(InputPartition):
    def __init__(self, path: str, depth: int, below: bool):
        self.path, self.depth, self.below = path, depth, below


def _folders(path: str) -> list[str]:
    return sorted(e.path for e in os.scandir(path) if e.is_dir(follow_symlinks=False) and not is_junk_dir(e.name))


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, exts: set[str], most: int):
        self.root, self.exts, self.most = root, exts, most

    def partitions(self):
        """A partition for the files of each listed folder alone, and one for each whole folder below these."""
        own, whole, depth = [], [self.root], 1
        while len(whole) < SPLITS and depth <= min(LISTED, self.most) and whole:
            own += [_Folder(p, depth, False) for p in whole]
            whole = [f for p in whole for f in _folders(p)] if depth < self.most else []
            depth += 1
        return [*own, *(_Folder(p, depth, True) for p in whole)]

    def read(self, partition):
        todo = [(partition.path, partition.depth)]
        while todo:
            folder, depth = todo.pop()
            for e in sorted(os.scandir(folder), key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False):
                    if partition.below and depth < self.most and not is_junk_dir(e.name):
                        todo.append((e.path, depth + 1))
                elif e.is_file() and not is_junk_file(e.name):
                    ext = os.path.splitext(e.name)[1].lower().lstrip(".")
                    if not self.exts or ext in self.exts:
                        s = e.stat()
                        yield e.path, e.name, ext, s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9


class FileTree(DataSource):
    """Files below a folder that all executors see. Options: root, extensions (comma-separated), max_depth
    (1: files directly in the root). Junk files and folders are left out; symbolic links to folders are not
    followed; other dotfiles count."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return FILE

    def reader(self, schema):
        o = self.options
        exts = {x.strip().lower().lstrip(".") for x in o.get("extensions", "").split(",") if x.strip()}
        return _TreeReader(o["root"], exts, int(o.get("max_depth", 1 << 30)))


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    spark.dataSource.register(FileTree)
    reader = spark.read.format("filetree").option("root", root).option("extensions", ",".join(extensions))
    return (reader if max_depth is None else reader.option("max_depth", max_depth)).load()


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of the files in any store that Spark reads; contents are not read. Names that
    begin with a dot or an underscore are hidden by Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.selectExpr("path", "length as size_bytes", "unix_seconds(modificationTime) as mtime_secs")


def digest_stream(read, algorithms: tuple[str, ...]) -> dict:
    """Digests in one pass over read(n) -> bytes."""
    tools = {a: hashlib.new(a) for a in algorithms if a != "crc32"}
    crc, size = 0, 0
    while block := read(CHUNK):
        size += len(block)
        if "crc32" in algorithms:
            crc = zlib.crc32(block, crc)
        for t in tools.values():
            t.update(block)
    out = {a: t.hexdigest() for a, t in tools.items()}
    if "crc32" in algorithms:
        out["crc32"] = f"{crc:08x}"
    return out | {"size_bytes": size}


def hash_files(files: DataFrame, algorithms: tuple[str, ...] = ("crc32", "sha1")) -> DataFrame:
    """A report row for each path. A file that can't be read fails alone. Digests that are not asked for are
    null and cost nothing. Only a chunk is in memory; files are spread by path."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                began, got, error = time.monotonic(), {}, None
                try:
                    with open(path, "rb") as f:
                        got = digest_stream(f.read, algorithms)
                except OSError as e:
                    error = str(e)
                rows.append((path, got.get("crc32"), got.get("sha1"), got.get("md5"), got.get("sha256"), got.get("size_bytes"), "failed" if error else "ok", int((time.monotonic() - began) * 1000), error))
            yield pd.DataFrame(rows, columns=HASH_REPORT.names).astype({"size_bytes": "Int64"})

    return files.select("path").mapInPandas(run, HASH_REPORT)


_CUE = re.compile(r'^\s*(FILE|TRACK|INDEX|PREGAP|POSTGAP)\s+(?:"([^"]*)"|(\S+))(?:\s+(\S+))?', re.I)


def _frames(text: str) -> int:
    m, s, f = map(int, text.split(":"))
    return (m * 60 + s) * 75 + f


def parse_cue(text: str) -> list[dict]:
    """Tracks of a cue sheet, in order, with file, type, gaps and indices in frames."""
    tracks, files = [], []
    for line in text.lstrip("﻿").splitlines():
        m = _CUE.match(line)
        if not m:
            continue
        word, value, rest = m[1].upper(), m[2] if m[2] is not None else m[3], m[4]
        if word == "FILE":
            files.append(value)
        elif word == "TRACK":
            if not files:
                raise ValueError("a track before any file")
            tracks.append({"number": int(value), "track_type": (rest or "").upper(), "file_index": len(files) - 1, "file_name": files[-1], "pregap_frames": 0, "postgap_frames": 0, "indices": []})
        elif not tracks:
            raise ValueError(f"{word.lower()} before any track")
        elif word == "INDEX":
            tracks[-1]["indices"].append({"number": int(value), "frames": _frames(rest)})
        else:
            tracks[-1][f"{word.lower()}_frames"] = _frames(value)
    return tracks


def cue_tracks(cues: DataFrame) -> DataFrame:
    """A row for each track of cue sheets (path, value: the sheet's text)."""
    from ledgerlake.schemas import CUE_TRACK

    def run(batches):
        for batch in batches:
            rows = [{"cue": p} | t for p, v in zip(batch["path"], batch["value"]) for t in parse_cue(v or "")]
            yield pd.DataFrame(rows, columns=CUE_TRACK.names)

    return cues.select("path", "value").mapInPandas(run, CUE_TRACK)
