"""Ordered blocks, running offsets and range lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.scratch import stored


def running_offset(df: DataFrame, group: list[str], order: list[str], length: str, name: str = "start") -> DataFrame:
    """df with the sum of the lengths before each row of its group. The order must be total."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)))


def next_in_order(df: DataFrame, order: str, value: str, name: str = "next", bits: int = 12) -> DataFrame:
    """df with the following row's value by one ascending whole-number order over the whole table.

    A global window would run in one task. Rows are cut into ranges of the order instead: within a range a
    window finds the next row, and a small table of the ranges' first values serves their last rows.
    """
    cut = df.withColumn("__r", F.shiftright(F.col(order).cast("long"), bits))
    first = cut.groupBy("__r").agg(F.min_by(value, order).alias("__v"))
    # one row a range, and again in ranges of ranges, so that the small table is not ordered in one task
    wide = first.withColumn("__w", F.shiftright("__r", bits))
    tops = wide.groupBy("__w").agg(F.min_by("__v", "__r").alias("__v2")).withColumn("__n2", F.lead("__v2").over(Window.orderBy("__w")))
    after = wide.withColumn("__n", F.lead("__v").over(Window.partitionBy("__w").orderBy("__r"))).join(tops.select("__w", "__n2"), "__w").select("__r", F.coalesce("__n", "__n2").alias("__n"))
    inside = cut.withColumn("__own", F.lead(value).over(Window.partitionBy("__r").orderBy(order)))
    return inside.join(after, "__r", "left").withColumn(name, F.coalesce("__own", "__n")).drop("__r", "__own", "__n")


def contiguous(df: DataFrame, group: list[str], order: list[str], length: str) -> DataFrame:
    """(group, ok): whether each span starts where the one before ends, the first at 0, given start and length."""
    w = Window.partitionBy(*group).orderBy(*order)
    ends = df.withColumn("__e", F.coalesce(F.lag(F.col("start") + F.col(length)).over(w), F.lit(0)))
    return ends.groupBy(*group).agg(F.min((F.col("start") == F.col("__e")).cast("int")).alias("ok"))


def index_faults(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(container, fault) of block indices (container, block_no, offset, raw) that are not sound, given
    (container, size_bytes, n_blocks): offsets may repeat but not fall, the entry after the last block must
    be the file's size and carry no raw mark."""
    w = Window.partitionBy("container").orderBy("block_no")
    falls = blocks.withColumn("n", F.lead("offset").over(w)).where("n < offset").select("container", F.lit("offset falls").alias("fault"))
    last = blocks.join(sizes, "container").where("block_no = n_blocks")
    ends = last.where("offset <> size_bytes").select("container", F.lit("end differs").alias("fault"))
    marks = last.where("raw").select("container", F.lit("end is raw").alias("fault"))
    return falls.unionByName(ends).unionByName(marks).distinct()


def in_ranges(points: DataFrame, value: Column, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """points joined with the ranges that hold their value (ends included), by equality of cells, so no nested loop is
    planned however many ranges there are.

    A range is entered at the level of cells at least as wide as itself, of which it touches two at most, whatever
    its length; a point is looked up once in each level that any range has, at most 64. Ranges that end before
    they begin and null ends or values match nothing.
    """
    wide = ranges.where(F.col(low) <= F.col(high)).withColumns({"__a": F.floor(low), "__b": F.floor(high)})
    wide = wide.withColumn("__l", F.ceil(F.log2((F.col("__b") - F.col("__a") + 1).cast("double"))).cast("int"))
    cells = wide.withColumn("__c", F.explode(F.array_distinct(F.array(F.expr("shiftright(__a, __l)"), F.expr("shiftright(__b, __l)"))))).drop("__a", "__b")
    levels = sorted(r[0] for r in wide.select("__l").distinct().collect())
    at = points.withColumn("__v", value).withColumn("__l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    at = at.withColumn("__c", F.expr("shiftright(cast(floor(__v) as bigint), __l)"))
    return at.join(cells, ["__l", "__c"]).where((F.col("__v") >= F.col(low)) & (F.col("__v") <= F.col(high))).drop("__l", "__c", "__v")


def slots(df: DataFrame, group: list[str], order: list[str], used: Column) -> DataFrame:
    """df with the running number of used blocks (from 1); null for unused ones."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("slot", F.when(used, F.sum(used.cast("long")).over(w)))


def chased(links: DataFrame) -> DataFrame:
    """(node, root): self-references followed to blocks that refer to no other (ref null). Steps double until nothing
    moves or all nodes have been passed, so chains of any length take few joins. Cycles and references to unknown
    nodes give null. Each round is written, so none is worked out again."""
    now, n, steps = stored(links.select("node", F.coalesce("ref", "node").alias("root"))), links.count(), 1
    while steps < n:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        new = stored(now.join(up, "root", "left").select("node", F.coalesce("__up", "root").alias("root"), (F.coalesce("__up", "root") != F.col("root")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        now, steps = new.select("node", "root"), 2 * steps
        if not moved:
            break
    ends = links.where("ref is null").select(F.col("node").alias("root"), F.lit(True).alias("__end"))
    return now.join(ends, "root", "left").select("node", F.when(F.col("__end"), F.col("root")).alias("root"))


def with_index(tracks: DataFrame, group: list[str], order: list[str], frames: str) -> DataFrame:
    """tracks with the frame of each one's INDEX 01: the frames of the tracks before it. Pregaps don't count."""
    return running_offset(tracks, group, order, frames, "index_01")


def chunked(items: DataFrame, group: str, order: str, size: str, most: int = 100, most_bytes: int = 256 << 10, frame: int = 12) -> DataFrame:
    """(group, order, chunk): items packed greedily in order, `most` a chunk and `most_bytes` with a frame and a byte
    between items; a larger item has a chunk of its own. A group is one request, so it fits in a row."""
    state = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(frame).cast("long").alias("bytes"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        full = (acc["n"] >= most) | ((acc["n"] > 0) & (acc["bytes"] + x["s"] + 1 > most_bytes))
        n = F.when(full, F.lit(0)).otherwise(acc["n"])
        chunk = acc["chunk"] + F.when(full, F.lit(1)).otherwise(F.lit(0))
        total = F.when(n == 0, frame + x["s"]).otherwise(acc["bytes"] + x["s"] + 1)
        return F.struct(chunk.cast("int").alias("chunk"), (n + 1).cast("int").alias("n"), total.cast("long").alias("bytes"), F.concat(acc["out"], F.array(chunk.cast("int"))).alias("out"))

    held = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items"))
    chunks = held.withColumn("c", F.aggregate("items", state, step)["out"])
    return chunks.select(group, F.explode(F.arrays_zip("items", "c")).alias("z")).select(group, F.col("z.items.o").alias(order), F.col("z.c").alias("chunk"))
