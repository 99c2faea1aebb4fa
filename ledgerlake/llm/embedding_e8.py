"""Embedding near-dedup by E8 lattice hashing.

Unit vectors are projected on random orthonormal directions, sixteen a table, and each half of the
projection is decoded to its nearest E8 lattice point. The two points and the label are the home cell of a
vector in that table. Each vector is also entered in neighbouring cells: those where one half or both are
replaced by the lattice point next in distance. A pair is a candidate where a home cell of one is a home or
probed cell of the other, and is verified by its cosine in double precision.

The cell size follows from the threshold, and the directions are random, so the chance of missing a pair at
the threshold depends on the number of tables alone, not on the data or its size (the tests measure it).

No pair leaves a task. Cells are dealt out in blocks of bounded size; a block counts the links of its
vectors and keeps a spanning forest of them. A pair that meets in several cells is counted in the first:
both vectors' cells follow from the vectors themselves, so each block can tell on its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_partitions, written
from .components import connected_components

THRESHOLD = 0.98
TABLES = 10
SEED = 20
#: Length, in lattice units, of half a table's difference between vectors at the threshold.
REACH = 0.283
#: Vectors of one cell that a block holds.
BLOCK = 1024
_LIMIT = 1 << 16


@lru_cache(maxsize=1)
def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.vstack([np.array(out), signs[(signs < 0).sum(1) % 2 == 0]])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    off = x - r
    odd = np.nonzero(r.sum(1) % 2)[0]
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] < 0, -1, 1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row, doubled (so in whole numbers)."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return (2 * np.where(near[:, None], a, b)).astype(np.int16)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def _hashed(points: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of eight small whole numbers."""
    return _mixed(np.ascontiguousarray(points, np.int8).view(np.uint64).ravel() + np.uint64(0x9E3779B97F4A7C15))


class Hasher:
    def __init__(self, dims: int, tables: int = TABLES, threshold: float = THRESHOLD, seed: int = SEED):
        self.dims, self.tables = dims, tables
        wide = max(16, -(-dims // 16) * 16)
        rng = np.random.default_rng(seed)
        rows = []
        while len(rows) < tables:
            q = np.linalg.qr(rng.standard_normal((wide, wide)))[0]
            rows += [q[k : k + 16] for k in range(0, wide, 16)]
        chord = np.sqrt(2 - 2 * threshold) or 1e-6
        self.matrix = np.concatenate(rows[:tables])[:, :dims].T * (REACH / (chord * np.sqrt(8 / wide)))

    def cells(self, unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Cells of each vector in each table: [vector, table, 4], the home cell first."""
        n = len(unit)
        x = (unit @ self.matrix).reshape(n * self.tables * 2, 8)
        home = nearest_e8(x)
        step = _neighbours()
        best = ((x - home / 2) @ step.T).argmax(1)
        first = _hashed(home).reshape(n, self.tables, 2)
        other = _hashed(home + step[best]).reshape(n, self.tables, 2)
        salt = _mixed(labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(self.tables, dtype=np.uint64))
        turn = np.uint64(0xD6E8FEB86659FD93)
        pairs = [(first, first), (other, first), (first, other), (other, other)]
        return np.stack([_mixed(a[..., 0] ^ (b[..., 1] * turn) ^ salt) for a, b in pairs], axis=2).view(np.int64)


@lru_cache(maxsize=8)
def hasher(dims: int, tables: int, threshold: float) -> Hasher:
    return Hasher(dims, tables, threshold)


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _met_first(cells: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows: the first table in which they meet, and the cell that counts for them there."""
    ha, hb = cells[a, :, 0], cells[b, :, 0]
    forth = (cells[b] == ha[:, :, None]).any(2)  # b is at home in a's home cell, or probes it
    back = (cells[a] == hb[:, :, None]).any(2)
    table = (forth | back).argmax(1)
    k = np.arange(len(a))
    return table, np.where(forth[k, table], ha[k, table], hb[k, table])


class _Forest:
    """Links that join what no earlier link of the block has joined."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _link_blocks(dims: int, tables: int, threshold: float):
    """Maps sorted rows (cell, ca, cb, chunk, node, weight, home, label, vec) to (node, n) and (node, to)."""

    def pairs_of(cell, node, chunk, ca, cb, unit):
        """Row pairs of whole groups that are linked."""
        starts = np.concatenate(([0], np.nonzero((cell[1:] != cell[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1]))[0] + 1, [len(cell)]))
        sizes = np.diff(starts)
        found = []
        big = sizes > 48
        for s, n in zip(starts[:-1][big], sizes[big]):
            u = unit[s : s + n]
            i, j = np.nonzero(np.triu(u @ u.T >= threshold - 1e-9, 1))
            found.append((i + s, j + s))
        for n in np.unique(sizes[~big]):
            if n > 1:
                i, j = np.triu_indices(n, 1)
                at = starts[:-1][sizes == n]
                for k in range(0, len(at), max(1, _LIMIT // len(i))):
                    w = at[k : k + max(1, _LIMIT // len(i))]
                    a, b = (w[:, None] + i).ravel(), (w[:, None] + j).ravel()
                    good = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold - 1e-9
                    found.append((a[good], b[good]))
        a = np.concatenate([x for x, _ in found] or [np.zeros(0, int)])
        b = np.concatenate([x for _, x in found] or [np.zeros(0, int)])
        # a block of two chunks holds the pairs across them; those within are in the block of one chunk
        across = (chunk[a] != chunk[b]) | (ca[a] == cb[a])
        a, b = a[across], b[across]
        swap = node[a] > node[b]
        return np.where(swap, b, a), np.where(swap, a, b)

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            table = rest if batch is None else batch if rest is None else pa.concat_tables([rest, batch])
            if table is None or table.num_rows == 0:
                continue
            cell, ca, cb = (table.column(c).to_numpy() for c in ("cell", "ca", "cb"))
            end = len(cell)
            if batch is not None:
                changes = np.nonzero((cell[1:] != cell[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1]))[0]
                end = int(changes[-1]) + 1 if len(changes) else 0
            rest = table.slice(end)
            if not end:
                continue
            table = table.slice(0, end).combine_chunks()
            cell, ca, cb = cell[:end], ca[:end], cb[:end]
            node, chunk, label, weight = (table.column(c).to_numpy() for c in ("node", "chunk", "label", "weight"))
            unit = _units(table.column("vec").combine_chunks())
            a, b = pairs_of(cell, node, chunk, ca, cb, unit)
            keep = np.zeros(len(a), bool)
            hash_of = hasher(dims, tables, threshold)
            for k in range(0, len(a), _LIMIT):
                i, j = a[k : k + _LIMIT], b[k : k + _LIMIT]
                x, y = unit[i], unit[j]
                same = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold
                rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                cells = hash_of.cells(unit[rows], label[rows])
                _, counts = _met_first(cells, at[: len(i)], at[len(i) :])
                keep[k : k + _LIMIT] = same & (counts == cell[i])
            a, b = a[keep], b[keep]
            ends = np.concatenate([node[a], node[b]])
            who, place = np.unique(ends, return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([weight[b], weight[a]]), minlength=len(who)).astype(np.int64)
            forest = _Forest()
            tree = [(p, q) for p, q in zip(node[a].tolist(), node[b].tolist()) if forest.add(p, q)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([who, [p for p, _ in tree]]).astype(np.int64)), pa.array(np.concatenate([n, np.zeros(len(tree), np.int64)])), pa.array([None] * len(who) + [q for _, q in tree], pa.int64())], names=["node", "n", "to"])

    return run


def _with_end(batches):
    for batch in batches:
        yield pa.Table.from_batches([batch])
    yield None


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Vectors are compared only where labels are equal and not null and lengths are equal. Null, empty or
    zero vectors and those with null or non-finite components link with nothing. Equal vectors are
    compared once and count as often as they occur. Rows that repeat an id are vectors of their own.
    component_id is the smallest id reachable (null where none has one); kept is false for a null id.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"), F.col(label).cast("long").alias("label"))
    sound = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.where("sound").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("vec")), "e8classes")
    links = None
    for (dims,) in sorted(tuple(r) for r in classes.select("dims").distinct().collect()):
        of_size = _links_of(classes.where(F.col("dims") == dims), dims, threshold, tables, block, n_partitions(spark))
        links = of_size if links is None else links.unionByName(of_size)
    if links is None:
        links = spark.createDataFrame([], "node long, n long, to long")
    links = written(links, "e8links")
    parts = connected_components(links.where("to is not null"), "node", "to")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    of = classes.select("node", "least", "weight", "label", "vec").join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = written(of, "e8of")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(of.join(least, "component").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "e8done")
    linked = rows.where("sound").join(of, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_of(classes: DataFrame, dims: int, threshold: float, tables: int, block: int, parts: int) -> DataFrame:
    def enter(batches):
        hash_of = hasher(dims, tables, threshold)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                cells = hash_of.cells(_units(part.column(1)), part.column(2).to_numpy())
                home = np.zeros(cells.shape, bool)
                home[:, :, 0] = True
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(home.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), tables * 4))], names=["cell", "home", "node"])

    entered = written(classes.select("node", "vec", "label").mapInArrow(enter, "cell long, home boolean, node long"), "e8cells")
    sizes = entered.groupBy("cell").agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).where("size > 1 and homes > 0")
    met = entered.join(sizes, "cell").select("cell", "node", F.ceil(F.col("size") / block).cast("long").alias("chunks"))
    met = met.withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)")).withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
    met = met.select("cell", "node", "chunk", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb"))
    full = met.join(classes.select("node", "vec", "label", "weight"), "node")
    dealt = full.repartition(parts, "cell", "ca", "cb").sortWithinPartitions("cell", "ca", "cb")
    return dealt.mapInArrow(_link_blocks(dims, tables, threshold), "node long, n long, to long")
