"""All pairs of texts whose sets of word shingles have a Jaccard similarity of four fifths or more.

Copies that differ in a fifth of their shingles differ in about ten of 64 SimHash bits, where no key is
selective. They are found by prefixes instead, which is exact: in any fixed order of all shingles, two such
sets share one of the first n - ceil(4n/5) + 1 of each. The order puts shingles that are common in a sample
last and those of rare words first, so lists of texts with a shingle are short however many texts there are; the
sample bears on the time alone, never on the result.

Before that, copies are connected through few links: texts whose least shingle agrees, in one of several random
orders, are compared with one of them, a hub. Of the lists then only pairs count that are not yet connected, so
groups of many copies make no pairs, and whoever asks for groups loses no link. Lists stay tables of rows; those of
shingles that are very common in the sample are dealt out in parts while it is found out which lists matter.

A set's sketch has a bit for each of 512 classes of shingles: whether it holds an odd number of them. Sets whose
sketches differ in d bits differ in d shingles at least, so most pairs are ruled out, none wrongly, before texts
are compared: first by 512 classes, where pairs are listed, then by more classes than the sets have shingles, since
512 say nothing of long texts. Lists are paired off, and sketches and texts go to the tasks that compare them, in
portions, one after another, so the disk they take follows the texts and not the pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import enter, release, written
from .components import connected_components

SHINGLE = 5
#: Texts in the sample, and how often a common shingle occurs in it, and one whose list is dealt out in PARTS.
SAMPLE, COMMON, HOT, PARTS = 20_000, 3, 60, 64
#: Random orders of the shingles, and texts that one copy of a hub is compared with.
ORDERS, DEALT = 6, 256
#: Common shingles that are told apart by their count; others count as rare, which costs time alone.
TOLD = 500_000
#: Words that are told apart by their count in the sample; others count as rare, which costs time alone.
WORDS = 200_000
#: Shingles of the texts that move at once: at most this share of all, or so many.
MOVED, LEAST_MOVED = 0.5, 1 << 22
#: Rows of lists that are paired off at once: at most this share of all shingles, or LEAST_MOVED.
LISTED = 0.04
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def word_hashes(text: str) -> np.ndarray:
    """The 64-bit hashes of a text's words, in their order."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _runs(h: np.ndarray, shingle: int) -> np.ndarray:
    """The hash of each run of so many words, of their hashes; fewer words are one run."""
    size = min(shingle, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _MIX[0]
        out = (out ^ (out >> np.uint64(29))) * _MIX[1]
        out ^= out >> np.uint64(32)
    return out


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    h = word_hashes(text)
    return np.unique(_runs(h, shingle)).view(np.int64) if len(h) else np.zeros(0, np.int64)


def mark(hashes: np.ndarray) -> int:
    """The name of a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


SKETCH = tuple(f"s{k}" for k in range(8))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 512 parity bits of a set of shingles, as eight integers."""
    odd = np.bincount((hashes >> np.int64(20)) & 511, minlength=512).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


MINS = tuple(f"m{k}" for k in range(ORDERS))
_TURN = np.random.default_rng(7).integers(1, 1 << 63, ORDERS, np.uint64) | np.uint64(1)


def leasts(hashes: np.ndarray) -> np.ndarray:
    """The least shingle of a set in each of the random orders, as a number that names it."""
    x = hashes.view(np.uint64)[:, None] * _TURN
    return (x ^ (x >> np.uint64(32))).min(0).view(np.int64)


def _mapped(docs: DataFrame, each, schema: str, names: list[str]) -> DataFrame:
    """Rows that each(word hashes) gives as arrays, for the texts of docs that have words."""

    def run(batches):
        enter("jaccard")
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            got = [each(w) for t in batch.column(0) if len(w := word_hashes(t.as_py()))]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=names)

    return docs.select("text").mapInArrow(run, schema)


def _commonest(values: DataFrame, most: int, label: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of h that occur COMMON times or more, at most so many, in order, and their counts."""
    counts = written(values.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), label)
    got = counts.orderBy(F.desc("n")).limit(most).toArrow()
    release(counts)
    h, n = (got.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, in order, and their counts; words likewise, and their weights, which
    are sixteenths of the binary logarithm of their counts."""
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0)
    common, counts = _commonest(_mapped(part, lambda w: (np.unique(_runs(w, SHINGLE)).view(np.int64),), "h long", ["h"]), TOLD, "jaccardcommon")
    words, often = _commonest(_mapped(part, lambda w: (w.view(np.int64),), "h long", ["h"]), WORDS, "jaccardwords")
    return common, counts, words, np.rint(16 * np.log2(often)).astype(np.int64)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, zero where the sorted keys have none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def prefix(w: np.ndarray, common: np.ndarray, counts: np.ndarray, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted shingles of a text, by its word hashes; the first of them in the order, as many as two similar sets
    share one of; and their counts in the sample. Arguments are as `_common` gives them."""
    h, at = np.unique(_runs(w, SHINGLE), return_index=True)
    h, n = h.view(np.int64), len(h)
    rank = _looked_up(common, counts, h)
    total = np.concatenate(([0], np.cumsum(_looked_up(words, weights, w.view(np.int64)))))
    size = min(SHINGLE, len(w))
    chosen = np.lexsort((h, (total[size:] - total[:-size])[at], rank))[: n - -(-4 * n // 5) + 1]
    return h, h[chosen], rank[chosen]


def _postings(docs: DataFrame) -> DataFrame:
    """(tok, part, t, n, pos, prev): the prefix of each text's set t of n shingles, pos counting from zero, prev the
    shingle before (t for the first). part is -1 but for shingles that are very common, whose lists are dealt out."""
    held = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def each(w):
        h, first, rank = prefix(w, *held.value)
        n, t = len(h), mark(h)
        part = np.where(rank >= HOT, t % PARTS, -1).astype(np.int32)
        return first, part, np.full(len(first), t), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32), np.concatenate(([t], first[:-1]))

    return _mapped(docs, each, "tok long, part int, t long, n int, pos int, prev long", ["tok", "part", "t", "n", "pos", "prev"])


#: Whether two texts that first meet at this shingle can be similar: by their sizes, and by what follows.
_CAN = "5L * least(a.n, b.n) >= 4L * greatest(a.n, b.n) and 9L * least(a.n - a.pos, b.n - b.pos) >= 4L * (a.n + b.n)"
#: The same by the sketches: similar sets differ in a ninth of their sizes at most.
_NEAR = "9 * (" + " + ".join(f"bit_count(a.{s} ^ b.{s})" for s in SKETCH) + ") <= a.n + b.n"


def long_sketch(hashes: np.ndarray) -> bytes:
    """A set's size and its parity bits, at least four for each shingle: a power of two of classes, as `sketch` has."""
    m = max(512, 1 << (4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.int64(20)) & (m - 1), minlength=m).astype(np.uint8) & 1
    return len(hashes).to_bytes(8, "little") + np.packbits(odd, bitorder="little").tobytes()


def _read_sketch(x: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(x[:8], "little"), np.frombuffer(x, np.uint64, offset=8)


def _close(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
    """Whether sets with these long sketches can be similar. Of sketches of two lengths the longer one is folded."""
    (n, x), (m, y) = a, b
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= n + m


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _compared(pairs: DataFrame, things: DataFrame, sets: DataFrame, weight: float, read, test, label: str) -> list[DataFrame]:
    """The pairs (a, b) of a written table whose things (t, x) pass the test once they are read, as written tables. A
    thing goes once to each task that compares others with it; one with many partners is compared in several tasks.
    Where more goes than a share of all texts, the tasks run in several portions; weight is a thing's size in texts."""
    shares = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).cast("long").alias("shares")), "jaccardshares")
    moved = pairs.join(sets.select(F.col("t").alias("b"), "n"), "b").agg(F.sum("n").alias("n")).first().n or 0
    whole = sets.agg(F.sum("n").alias("n")).first().n or 0
    portions = max(1, math.ceil(weight * moved / max(LEAST_MOVED, MOVED * whole)))
    tasks = shares.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"))
    tasks = tasks.unionByName(pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"), "b"))
    tasks = written(tasks.withColumn("portion", F.pmod(F.xxhash64("a", "share", F.lit(2)), F.lit(portions)).cast("int")), "jaccardtasks")

    def run(batches):
        enter("jaccard")
        head = None
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            good = []
            for b, x in zip(batch.column(2).to_pylist(), batch.column(3)):
                x = read(x.as_py())
                if b is None:  # stands before those that are compared with it
                    head = x
                good.append(b is not None and test(head, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    good = []
    for k in range(portions):
        now = tasks.where(F.col("portion") == k).withColumn("t", F.coalesce("b", "a")).join(things, "t").select("a", "share", "b", "x")
        both = now.repartition("a", "share").sortWithinPartitions("a", "share", "b")
        good.append(written(both.mapInArrow(run, "a long, b long"), label))
    release(shares, tasks)
    return good


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """The pairs (a, b) whose sets are similar, by their sets, as written tables. Long sketches are compared first, so
    few texts move."""
    pairs = written(pairs, "jaccardpairs")
    ends = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    wanted = written(texts.join(ends, "t", "left_semi").groupBy("t").agg(F.min("x").alias("x")), "jaccardwanted")
    few = docs.withColumn("x", F.xxhash64("text")).join(wanted.select("x"), "x", "left_semi").dropDuplicates(["x"])
    named = written(few.join(wanted, "x").select("t", F.col("text").alias("x")), "jaccardnamed")

    def run(batches):
        enter("jaccard")
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            found = [long_sketch(shingles(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["t", "x"])

    sketched = written(named.mapInArrow(run, "t long, x binary"), "jaccardbits")
    left = _compared(pairs, sketched, sets, 0.125, _read_sketch, _close, "jaccardclose")
    good = _compared(reduce(DataFrame.unionByName, left), named, sets, 1, shingles, _similar, "jaccardgood")
    release(pairs, wanted, named, sketched, *left)
    return good


def _hubs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of hubs and texts that share a least shingle, where the sketches don't rule them out."""
    found = None
    whole = ("t", "n", *SKETCH)
    for k, least in enumerate(MINS):
        hub = sets.groupBy(least).agg(F.min(F.struct(F.xxhash64("t", F.lit(k)).alias("o"), *whole)).alias("a"))
        star = sets.select(least, F.struct(*whole).alias("b")).join(hub, least).where(f"a.t <> b.t and {_NEAR}")
        star = star.select(F.col("a.t").alias("a"), F.col("b.t").alias("b"))
        found = star if found is None else found.unionByName(star)
    return found.distinct()


def similar_links(docs: DataFrame, fp: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of texts with a similarity of four fifths or more, enough of them
    for every such pair to be connected. docs has a column text without nulls. fp has a row for each text:
    its fingerprint fp, its set t (null without words), the set's size n, sketch and least shingles, and x, Spark's
    hash of the text."""
    fp = fp.where("t is not null")
    texts = written(fp.groupBy("t", "x").agg(F.min("fp").alias("fp")), "jaccardtexts")
    sets = written(fp.groupBy("t").agg(*(F.min(c).alias(c) for c in ("n", *SKETCH, *MINS))), "jaccardsets")
    one = written(texts.groupBy("t").agg(F.min("fp").alias("one")), "jaccardones")
    same = texts.join(one, "t").where("fp <> one").select(F.col("one").alias("a"), F.col("fp").alias("b"))
    links = _verified(_hubs(sets), docs, texts, sets)
    of = written(connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "t"), "jaccardof")
    # one shuffle by list: distinct and both ends of a list need no other
    lists = _postings(docs).repartition("tok", "part").distinct()
    ends = Window.partitionBy("tok", "part")
    lists = lists.withColumns({"low": F.min("t").over(ends), "high": F.max("t").over(ends)}).where("low <> high or part >= 0")
    rows = written(lists.select("tok", "t", "n", "pos", "prev"), "jaccardlists")
    whole = sets.agg(F.sum("n").alias("n")).first().n or 0
    portions = max(1, math.ceil(rows.count() / max(LEAST_MOVED, LISTED * whole)))
    met = []
    for k in range(portions):
        now = rows.where(F.pmod(F.xxhash64("tok"), F.lit(portions)) == k)
        grouped = now.join(of, "t", "left").withColumn("c", F.coalesce("component", "t")).drop("component")
        # lists within one group have nothing left to compare
        span = grouped.groupBy("tok").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("tok")
        full = written(grouped.join(span, "tok", "left_semi").join(sets.select("t", *SKETCH), "t"), "jaccardfull")
        # texts that have the shingle before in common as well have met in its list already
        more = full.alias("a").join(full.alias("b"), F.expr(f"a.tok = b.tok and a.t < b.t and a.c <> b.c and a.prev <> b.prev and {_CAN} and {_NEAR}"))
        met.append(written(more.select(F.col("a.t").alias("a"), F.col("b.t").alias("b")).distinct(), "jaccardmet"))
        release(full)
    more = _verified(reduce(DataFrame.unionByName, met).distinct(), docs, texts, sets)
    all_ = reduce(DataFrame.unionByName, [*links, *more])
    named = all_.join(one.select(F.col("t").alias("a"), F.col("one").alias("u")), "a").join(one.select(F.col("t").alias("b"), F.col("one").alias("v")), "b")
    out = written(named.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(same).distinct(), "jaccardlinks")
    release(texts, one, rows, sets, of, *met, *links, *more)
    return out
