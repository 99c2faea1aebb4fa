"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits, padded to 23). The (23,12) Golay code
is perfect: every 23-bit word lies within three bits of exactly one codeword. A segment is looked up
under the codeword index of itself and of its 23 one-bit neighbours; that is one index where the segment
is within two bits of its codeword and six where it is three bits away. Two segments that differ in at
most two bits have a common neighbour and hence a common index.

Fingerprints that differ in two bits or fewer agree wholly in one segment (two errors cannot touch three
segments) and share an index in each other segment. A key is one whole segment and the index of the next
segment; every linked pair meets under such a key and is then verified.

Keys that are too full to be paired off are taken apart exactly instead of being capped: each of their
fingerprints goes under itself and its 64 one-bit neighbours. Two fingerprints are within two bits if and
only if they meet there, and no such meeting point has more than 65 members, so this stays linear.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, drop, enter, free_name, scratch, written
from .components import connected_components
from .near_jaccard import MINS, SKETCH, leasts, mark, shingles, similar_links, sketch

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Members up to which a key's fingerprints are paired off; beyond it the neighbour form takes over.
PAIRED = 24
#: Generator polynomial of the (23,12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 15
_BYTE_AT = np.arange(8, dtype=np.int64) * 256
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; zero where it has no words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :] - 1
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n)
    seen = np.zeros(8 * 256, np.int64)  # how often each value of each of the eight bytes occurs
    for k in range(0, n, _CHUNK):
        seen += np.bincount((h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=8 * 256)
    counts = (seen.reshape(8, 256) @ _BITS_OF).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The columns `keep` and the signed 64-bit fingerprint of `text` under `name`, row by row. Null text counts as
    empty (zero); repeated rows repeat; an empty table gives an empty result."""

    def run(batches):
        enter("simhash")
        for batch in batches:
            texts = batch.column(len(keep))
            out = np.fromiter((fingerprint(t.as_py() or "") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out.view(np.int64))], names=[*keep, name])

    got = docs.select(*keep, as_text(text).alias(free_name([*keep, name], "__text")))
    return got.mapInArrow(run, T.StructType([*got.schema.fields[: len(keep)], T.StructField(name, T.LongType())]))


@lru_cache(maxsize=1)
def golay_index() -> np.ndarray:
    """For each 23-bit word, the 12-bit index of its codeword (the 12 message bits of the systematic code)."""

    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - 11)), x)
        return x

    word = np.arange(1 << 23, dtype=np.int32)
    leader = np.zeros(1 << 11, np.int32)
    flips = np.array([0, *(1 << i for i in range(23))], np.int32)
    errors = np.unique((flips[:, None, None] ^ flips[None, :, None] ^ flips[None, None, :]).ravel())
    leader[remainder(errors)] = errors
    return ((word ^ leader[remainder(word)]) >> 11).astype(np.int16)


def golay_keys(segment: np.ndarray) -> np.ndarray:
    """24 codeword indices a segment: its own and those of its one-bit neighbours, with repeats."""
    table = golay_index()
    flips = np.array([0, *(1 << i for i in range(23))], np.int32)
    return table[segment.astype(np.int32)[:, None] ^ flips]


def key_table(fingerprints: DataFrame) -> DataFrame:
    """(key, fp) for the distinct fingerprints of the column fp. Repeated ones repeat; none gives none; nulls are
    not expected (`with_fingerprints` makes none)."""

    def run(batches):
        enter("golay", golay_index.cache_clear)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            parts = [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            for k in range(0, len(fp), 4096):
                for i in range(3):
                    index = np.sort(golay_keys(parts[(i + 1) % 3][k : k + 4096]), axis=1)
                    fresh = np.concatenate([np.ones((len(index), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
                    row, col = np.nonzero(fresh)
                    key = (parts[i][k : k + 4096][row] << 14) | (index[row, col].astype(np.int64) << 2) | i
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[k : k + 4096][row])], names=["key", "fp"])

    return fingerprints.select("fp").mapInArrow(run, "key long, fp long")


def fingerprint_links(fingerprints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between distinct fingerprints of at most MAX_BITS differing bits, enough of them for
    every such pair to be connected through links: pairs in small keys, stars in full ones."""
    spark = fingerprints.sparkSession
    key_path = scratch(spark, "golay")
    keys = written(key_table(fingerprints), "golay", key_path)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(sizes, "key"), "golaymet")
    drop(spark, key_path)
    small = met.where(F.col("n") <= paired).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    ends = small.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
    pairs = ends.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct()
    full = met.where(F.col("n") > paired).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(x).cast("long") for x in np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)).view(np.int64).tolist()))
    around = full.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("mid"))
    around = written(around, "around")
    hubs = around.groupBy("mid").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(hubs, "mid").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def _with_sets(docs: DataFrame) -> DataFrame:
    """The columns doc_id, fp, t, n, x, sketch and least shingles of docs (doc_id, text), as `similar_links` asks for."""
    names = ["fp", "t", "n", *SKETCH, *MINS]

    def run(batches):
        enter("simhash")
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            sets = [(mark(h), len(h), *sketch(h).tolist(), *leasts(h).tolist()) if len(h := shingles(t)) else (None,) * (len(names) - 1) for t in texts]
            columns = [pa.array(c, pa.int64()) for c in zip(*sets)] or [pa.array([], pa.int64())] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *columns, batch.column(2)], names=["doc_id", *names, "x"])

    got = docs.select("doc_id", "text", F.xxhash64("text").alias("x"))
    return got.mapInArrow(run, T.StructType([got.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in (*names, "x"))]))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """(doc_id, fp, grp, component_id): one row for each row of docs.

    similar also links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    grp names the group (its least fingerprint, signed). component_id is the smallest id among all rows
    reachable over links of at most two differing bits. Null text counts as empty (fingerprint zero,
    linked like any other). A row with a null id gets its group's smallest known id, or null. Repeated
    rows each get a row. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), as_text(text).alias("text"))
    prints = written(_with_sets(docs) if similar else with_fingerprints(docs), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    links = fingerprint_links(distinct)
    if similar:
        links = links.unionByName(similar_links(docs.select("text"), prints))
    parts = connected_components(links)
    group = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("grp"))
    group = written(group, "groups")
    least = group.groupBy("grp").agg(F.min("least").alias("component_id"))
    of_fp = written(group.select("fp", "grp").join(least, "grp").select("fp", "grp", "component_id"), "groupof")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "grp", "component_id")


def op1_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id)."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """docs without all but one document of each near-duplicate group; the row with the smallest id stays.
    similar: as in `simhash_groups`.

    Where rows of a group repeat that id, the one with the least fingerprint stays, then the first by its text
    and its other values. A group in which no row has an id keeps the row that is first by its text. Columns
    and their names stay as they are. An empty table gives an empty result.
    """
    names = docs.columns
    fp, grp = free_name(names, "__fp"), free_name(names, "__grp")
    groups = written(simhash_groups(docs, doc_id, text, similar), "grouped")
    kept = groups.where("doc_id = component_id").groupBy("grp").agg(F.min("doc_id").alias(doc_id), F.min("fp").alias(fp)).drop("grp")
    # only rows whose id repeats need more than their id to be told apart, so only these move with their texts
    repeated = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias(doc_id)).count().where("count > 1").select(doc_id)
    repeated = written(repeated, "repeatedids")
    single = docs.join(kept.join(repeated, doc_id, "left_anti"), doc_id, "left_semi").select(names)
    shared = with_fingerprints(docs.join(repeated, doc_id, "left_semi").select(names), text, tuple(names), fp)
    shared = _first_of(shared.join(kept, [doc_id, fp], "left_semi"), [doc_id, fp], names, text)
    nameless = with_fingerprints(docs.where(F.col(doc_id).isNull()), text, tuple(names), fp)
    alone = groups.where("doc_id is null and component_id is null").select(F.col("fp").alias(fp), F.col("grp").alias(grp)).distinct()
    return single.unionByName(shared).unionByName(_first_of(nameless.join(alone, fp), [grp], names, text))


def _first_of(rows: DataFrame, by: list[str], names: list[str], text: str) -> DataFrame:
    """Of rows that agree in `by` the one that is first by its text and then all its values."""
    whole = F.struct(*names)
    chosen = rows.groupBy(*(F.col(c).alias(f"by{k}") for k, c in enumerate(by))).agg(F.min_by(whole, F.struct(F.col(text), F.to_json(whole))).alias("row"))
    return chosen.select("row.*")
