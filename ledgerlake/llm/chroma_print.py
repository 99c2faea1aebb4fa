"""Chroma audio fingerprints, and alignment of recordings by offset histograms and bit errors.

Audio is cut into overlapping frames; each frame's power spectrum is folded into twelve pitch classes. Over
windows of sixteen frames, sums of rectangles in the pitch-class image, read off its integral image, are
compared by sixteen filters. Each comparison is quantised to two bits in Gray code, which gives one 32-bit
integer for each window.

Recordings with equal fingerprints form a class and are compared once. Query classes are taken in blocks of
bounded size. For every other class, equal integers vote for offsets, the offsets with most votes are taken
for each query, and the pair is aligned where the bits differ little over the whole overlap.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

WINDOW = 16
#: Largest share of differing bits and fewest overlapping windows of an alignment.
BIT_ERROR, OVERLAP = 0.15, 16
#: The same share where a recording has fewer windows than OVERLAP and overlaps with all of them.
SHORT_ERROR = 0.125
#: Offsets of a pair that are verified: those with most votes, and all that tie with the last of them.
VERIFIED = 8
#: Integers of query fingerprints in a block. A block is broadcast.
BLOCK = 1_000_000
#: Votes that are held at once.
HELD = 2_000_000
#: Samples that are transformed at once.
SAMPLES = 1 << 20
#: Cuts between the four levels of a filter's log ratio.
LEVELS = (-0.15, 0.0, 0.15)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of the sixteen filters, all different: the kinds in turn,
    over bands that step through the pitch classes, in three widths."""
    return [(k % 4, (5 * k + k // 4) % 12, 4 + 2 * (k % 3), (4, 8, 16)[(k // 4) % 3]) for k in range(16)]


class Printer:
    """Fingerprints of mono samples at a rate. frame and hop are in samples."""

    def __init__(self, rate: int = 8000, frame: int = 128, hop: int = 32):
        self.rate, self.frame, self.hop = rate, frame, hop
        self.least = frame + (WINDOW - 1) * hop
        freq = np.fft.rfftfreq(frame, 1 / rate)
        fold = np.zeros((len(freq), 12), np.float32)
        use = (freq >= 28) & (freq <= min(3520, rate / 2))
        fold[np.nonzero(use)[0], np.rint(12 * np.log2(freq[use] / 440)).astype(int) % 12] = 1
        self.fold = fold / np.maximum(fold.sum(0), 1)
        self.taper = np.hanning(frame).astype(np.float32)

    def chroma(self, frames: np.ndarray) -> np.ndarray:
        """Pitch-class shares of each frame (rows sum to 1; silent frames are even)."""
        centred = (frames - frames.mean(1, keepdims=True)) * self.taper
        spectrum = np.fft.rfft(centred, axis=1)
        image = (spectrum.real**2 + spectrum.imag**2) @ self.fold + np.float32(1e-6)
        return image / image.sum(1, keepdims=True)

    def windows(self, image: np.ndarray) -> np.ndarray:
        """The packed integer of each window of sixteen rows of a pitch-class image, whichever recordings
        its rows belong to."""
        n = len(image) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.uint32)
        whole = np.zeros((len(image) + 1, 25))
        np.cumsum(np.cumsum(np.hstack([image, image]), axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])

        def box(t, w, c, h):
            a, b = whole[t : t + n], whole[t + w : t + w + n]
            return b[:, c + h] - b[:, c] - a[:, c + h] + a[:, c]

        out = np.zeros(n, np.uint32)
        for kind, c, h, w in filters():
            t, half = (WINDOW - w) // 2, h // 2
            if kind == 0:  # the band against the opposite band
                x, y = box(t, w, c, half), box(t, w, (c + 6) % 12, half)
            elif kind == 1:  # the lower half of a band against the upper
                x, y = box(t, w, c, half), box(t, w, c + half, half)
            elif kind == 2:  # earlier against later
                x, y = box(t, w // 2, c, h), box(t + w // 2, w // 2, c, h)
            else:  # opposite corners
                x = box(t, w // 2, c, half) + box(t + w // 2, w // 2, c + half, half)
                y = box(t, w // 2, c + half, half) + box(t + w // 2, w // 2, c, half)
            level = np.searchsorted(LEVELS, np.log((x + 0.05) / (y + 0.05))).astype(np.uint32)
            out = out << np.uint32(2) | (level ^ (level >> np.uint32(1)))
        return out

    def prints(self, recordings: list[np.ndarray]) -> list[np.ndarray]:
        """Fingerprints of recordings. Short ones are filled up with silence to one window; empty ones have none."""
        out, group, held = [], [], 0
        for x in recordings:
            if held and held + len(x) > SAMPLES:
                out += self._grouped(group)
                group, held = [], 0
            group.append(x)
            held += len(x)
        return out + self._grouped(group)

    def _grouped(self, group: list[np.ndarray]) -> list[np.ndarray]:
        padded = [np.concatenate([x, np.zeros(self.least - len(x), np.float32)]) if 0 < len(x) < self.least else x for x in group]
        counts = [(len(x) - self.frame) // self.hop + 1 if len(x) else 0 for x in padded]
        if not sum(counts):
            return [np.zeros(0, np.int32) for _ in group]
        images = []
        for x, n in zip(padded, counts):
            for k in range(0, n, 1 << 14):
                part = x[k * self.hop : (min(n, k + (1 << 14)) - 1) * self.hop + self.frame]
                images.append(np.lib.stride_tricks.sliding_window_view(part, self.frame)[:: self.hop])
        rows = [self.chroma(np.concatenate(images[k : k + 256])) for k in range(0, len(images), 256)]
        packed = self.windows(np.concatenate(rows)).view(np.int32)
        at, out = 0, []
        for n in counts:
            out.append(packed[at : at + n - WINDOW + 1] if n else np.zeros(0, np.int32))
            at += n
        return out


def _wave(data: bytes) -> tuple[np.ndarray, int] | None:
    """(mono samples, rate) of RIFF WAVE data with linear PCM of 8 to 32 bits or floats; None for anything else.
    A data chunk that ends early counts as far as it goes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        at += 8
        if name == b"fmt " and size >= 16 and at + 16 <= len(data):
            code, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", data, at)
            if code == 0xFFFE and size >= 26 and at + 26 <= len(data):
                code = struct.unpack_from("<H", data, at + 24)[0]
            form = (code, channels, rate, bits // 8)
            if not channels or not rate or align != channels * (bits // 8) or (code, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                return None
        elif name == b"data":
            if form is None:
                return None
            code, channels, rate, wide = form
            raw = data[at : at + size]
            raw = raw[: len(raw) // (channels * wide) * channels * wide]
            if code == 3:
                x = np.frombuffer(raw, f"<f{wide}").astype(np.float32)
                x = np.clip(np.nan_to_num(x), -1, 1)
            elif wide == 1:
                x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
            elif wide == 3:
                b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8).astype(np.float32) / (1 << 23)
            else:
                x = np.frombuffer(raw, f"<i{wide}").astype(np.float32) / (1 << (8 * wide - 1))
            return x.reshape(-1, channels).mean(1, dtype=np.float32), rate
        at += size + size % 2
    return None


def samples(data: bytes | None, rate: int = 8000) -> np.ndarray:
    """Mono samples at `rate`: of WAV data (channels averaged, other rates resampled linearly), or of any other
    bytes, broken or unusual WAV data included, as unsigned 8-bit samples. Null and no bytes have none."""
    if not data:
        return np.zeros(0, np.float32)
    if (wave := _wave(data)) is None:
        return np.frombuffer(data, np.uint8).astype(np.float32) / 128 - 1
    x, own = wave
    if own == rate or not len(x):
        return x
    return np.interp(np.arange(max(1, len(x) * rate // own)) * (own / rate), np.arange(len(x)), x).astype(np.float32)


def fingerprints(media: DataFrame, rec_id: str, audio: Column, rate: int = 8000, frame: int = 128, hop: int = 32) -> DataFrame:
    """(rec_id, print array<int>, digest) of each row; digest is equal where fingerprints are.

    Null and empty audio have an empty fingerprint; any other bytes have one, see `samples`; recordings shorter
    than a window are filled up with silence. Null ids and repeated rows are rows like any other, further columns
    are ignored, an empty table gives an empty result. A recording's fingerprint is a cell: of 2 GB of 8-bit
    samples it has 64 million integers.
    """

    def run(batches):
        printer = Printer(rate, frame, hop)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = printer.prints([samples(x.as_py(), rate) for x in part.column(1)])
                marks = [hashlib.md5(p.tobytes()).hexdigest() for p in got]
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in got]))).astype(np.int32)
                ints = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ints, pa.array(marks)], names=["rec_id", "print", "digest"])

    got = media.select(F.col(rec_id).alias("rec_id"), audio.cast("binary").alias("audio"))
    return got.mapInArrow(run, T.StructType([got.schema["rec_id"], T.StructField("print", T.ArrayType(T.IntegerType(), False)), T.StructField("digest", T.StringType())]))


class Block:
    """Query fingerprints, ready for votes: every integer with its query and place."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        ints = np.concatenate([np.zeros(0, np.int32), *prints])
        order = np.argsort(ints, kind="stable")
        self.ints = ints[order]
        self.query = np.repeat(np.arange(len(prints)), [len(p) for p in prints])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in prints)])[order]
        self.flat = np.concatenate([np.zeros(0, np.int32), *prints])
        self.sizes = np.array([len(p) for p in prints], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.keys = np.array(ids, np.int64)

    def votes(self, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, offset, votes) of every offset that has a vote; offset: the query's place minus the recording's."""
        low, high = np.searchsorted(self.ints, print_, "left"), np.searchsorted(self.ints, print_, "right")
        n = high - low
        hit = np.nonzero(n)[0]
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(n[hit])
        k = 0
        while k < len(hit):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + HELD, "right")))
            rows, many = hit[k:stop], n[hit[k:stop]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(low[rows], many) + step
            key = self.query[at] << 32 | (self.place[at] - np.repeat(rows, many) + (1 << 31))
            got, count = np.unique(key, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, got]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, count]), len(keys)).astype(np.int64)
            k = stop
        return keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31), sums

    def aligned(self, own: int, print_: np.ndarray) -> list[dict]:
        """Alignments with the block's queries other than `own`: of the VERIFIED offsets with most votes the one
        with fewest differing bits (then the smallest) decides; it counts where the whole overlap agrees well enough.
        Recordings of fewer than OVERLAP windows align over their whole length."""
        query, offset, votes = self.votes(print_)
        if not len(query):
            return []
        order = np.lexsort((-votes, query))  # each query's offsets by votes; the VERIFIED-th has the least that count
        first = np.nonzero(np.concatenate(([True], query[order][1:] != query[order][:-1])))[0]
        ends = np.concatenate((first[1:], [len(order)]))
        least = np.zeros(len(self.ids), np.int64)
        least[query[order][first]] = votes[order][np.minimum(first + VERIFIED, ends) - 1]
        low = np.maximum(0, offset)
        overlap = np.minimum(self.sizes[query], len(print_) + offset) - low
        tried = np.nonzero((votes >= least[query]) & (overlap >= np.minimum(OVERLAP, np.minimum(self.sizes[query], len(print_)))) & (self.keys[query] != own))[0]
        best: dict[int, tuple] = {}
        ends = np.cumsum(overlap[tried])
        k = 0
        while k < len(tried):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + HELD, "right")))
            at, k = tried[k:stop], stop
            n = overlap[at]
            first = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(first, n)
            theirs = self.flat[np.repeat(self.starts[query[at]] + low[at], n) + step]
            differ = np.add.reduceat(np.bitwise_count((theirs ^ print_[np.repeat(low[at] - offset[at], n) + step]).view(np.uint32)), first, dtype=np.int64) / (32 * n)
            for j in np.nonzero(differ <= np.where(n < OVERLAP, SHORT_ERROR, BIT_ERROR))[0].tolist():
                i = at[j]
                q = int(query[i])
                best[q] = min(best.get(q, (2.0,)), (float(differ[j]), int(offset[i]), int(n[j]), int(votes[i])))
        return [{"query": self.ids[q], "offset": d, "overlap": n, "votes": v, "bit_error": e} for q, (e, d, n, v) in sorted(best.items())]


_ALIGNED = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("query", T.LongType()), ("offset", T.LongType()), ("overlap", T.LongType()), ("votes", T.LongType()), ("bit_error", T.DoubleType()))]))
_ARROW = pa.list_(pa.struct([("query", pa.int64()), ("offset", pa.int64()), ("overlap", pa.int64()), ("votes", pa.int64()), ("bit_error", pa.float64())]))


def align(prints: DataFrame, is_query: Column, block: int = BLOCK) -> DataFrame:
    """(rec_id, class_id, n_windows, is_query, aligned), one row for each row of prints.

    prints comes from `fingerprints`; is_query is a condition on rec_id. class_id is the smallest id with
    the same fingerprint (null where none of them has an id). aligned lists the alignments of the row that
    represents its class with the classes that hold a query; it is null in other rows. A class is not
    aligned with itself. Recordings without windows align with nothing.
    """
    spark = prints.sparkSession
    rows = written(prints.withColumn("row", F.monotonically_increasing_id()), "chromarows")
    asks = F.coalesce(is_query, F.lit(False))
    classes = rows.select("digest", "rec_id", "row", asks.alias("asks")).groupBy("digest").agg(F.min(F.struct(F.col("rec_id").isNull().alias("nameless"), "rec_id", "row")).alias("rep"), F.max("asks").alias("asked"))
    classes = written(classes.select("digest", F.col("rep.rec_id").alias("class_id"), F.col("rep.row").alias("row"), "asked"), "chromaclasses")
    reps = written(rows.select("row", "print").join(classes.select("row", "class_id", "asked"), "row"), "chromareps")
    asked = written(reps.where("asked and size(print) > 0"), "chromaqueries")
    found = None
    sized = asked.select("row", F.size("print").alias("n"))
    for low, high in _blocks(sized, block):
        part = asked.where((F.col("row") >= low) & (F.col("row") <= high)).orderBy("row").collect()
        held = spark.sparkContext.broadcast(([r.row for r in part], [r.class_id for r in part], [np.array(r.print, np.int32) for r in part]))

        def run(batches, held=held):
            keys, names, arrays = held.value
            block_ = Block(keys, arrays)
            name = dict(zip(keys, names))
            for batch in batches:
                out = []
                ints = batch.column(1)
                for row, p in zip(batch.column(0).to_pylist(), ints):
                    got = block_.aligned(row, p.values.to_numpy(zero_copy_only=False).astype(np.int32)) if len(p.values) else []
                    out.append([g | {"query": name[g["query"]]} for g in got])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ARROW)], names=["row", "aligned"])

        got = reps.select("row", "print").mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), T.StructField("aligned", _ALIGNED)]))
        got = written(got, "chromaaligned")
        held.destroy()
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = reps.select("row", F.array().cast(_ALIGNED).alias("aligned"))
    found = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("aligned"))).alias("aligned"))
    of = rows.select("rec_id", "row", "digest", F.size("print").cast("long").alias("n_windows"), asks.alias("is_query"))
    return of.join(classes.select("digest", "class_id"), "digest").join(found, "row", "left").select("rec_id", "class_id", "n_windows", "is_query", "aligned")


def _blocks(sized: DataFrame, block: int) -> list[tuple[int, int]]:
    """Row ranges that hold at most `block` integers each (or one recording). A range that holds more is
    halved; only sums reach the driver."""
    low, high, n = sized.agg(F.min("row"), F.max("row"), F.sum("n")).first()
    todo, out = ([] if low is None else [(low, high, n)]), []
    while todo:
        a, b, n = todo.pop()
        if n <= block or a == b:
            out.append((a, b))
            continue
        mid = (a + b) // 2
        for x, y in ((a, mid), (mid + 1, b)):
            r = sized.where((F.col("row") >= x) & (F.col("row") <= y)).agg(F.min("row"), F.max("row"), F.sum("n")).first()
            if r[0] is not None:
                todo.append(tuple(r))
    return sorted(out)


def op10_rows(docs: DataFrame) -> DataFrame:
    """Recordings are the UTF-8 bytes of whole texts as unsigned 8-bit samples at 8 kHz; queries are those
    whose id is divisible by 50. Null text is an empty recording."""
    prints = fingerprints(docs, "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    got = align(prints, F.col("rec_id") % 50 == 0)
    return got.withColumnRenamed("rec_id", "doc_id")
