"""Mixing sources to target weights by temperature, on DataFrame functions only.

A source's share of all tokens, p, is raised to an exponent and normalised: w = p^a / sum(p^a). At a = 1
sources keep their shares, at a = 0 all weigh the same. Entropy falls and the smallest sources repeat less
as the exponent grows, so both targets are met by bisection: the largest exponent that reaches the target
entropy, raised where a source would repeat more often than the limit allows.

Weights times the token budget are whole-token quotas. Each source's documents stand in a fixed random
order; the source is gone through as many whole times as its quota holds, and once more up to the document
in which the quota ends. A copy's place in its source's quota gives its block, so that every block holds
each source in proportion, and a hash gives its place within the block.

The order within a source is kept in hash ranges of about a thousand documents: ranges are summed first,
so a running total never needs all documents of a source in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

#: How far from the natural entropy to the even one the mix goes, how often a source may repeat, and the
#: tokens of a block.
EVENNESS = 0.5
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1_000_000
#: Documents in a hash range, on average.
RANGE = 1024
#: Sources up to which their table is broadcast.
MAX_BROADCAST = 50_000
#: Exponents tried at once in a pass, and passes: 33^8 exceeds 10^12.
_TRIED, _PASSES = 32, 8


def n_words(text: Column) -> Column:
    """Tokens for budgeting: runs of characters other than ASCII white space. Null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _narrowed(sources: DataFrame, holds, falling: bool) -> float:
    """The exponent in [0, 1] at which a condition changes; holds(z, zl, a, most) is evaluated for a pass of
    exponents in one aggregate with a row for each. falling: it holds up to that exponent, else from it."""
    low, high = 0.0, 1.0
    for _ in range(_PASSES):
        tried = [low + (high - low) * (k + 1) / (_TRIED + 1) for k in range(_TRIED)]
        power = F.pow("p", "a")
        each = sources.select("p", "t", F.posexplode(F.array(*map(F.lit, tried))).alias("k", "a")).groupBy("k", "a")
        found = each.agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"), F.max(power / F.col("t")).alias("most")).collect()
        good = [holds(r.z, r.zl, r.a, r.most) for r in sorted(found)]
        at = good.index(not falling) if (not falling) in good else _TRIED
        low, high = (tried[at - 1] if at else low), (tried[at] if at < _TRIED else high)
    return low if falling else high


def exponent(sources: DataFrame, budget: int, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for sources (p, t: share and number of tokens), to nine decimals.

    If even the natural shares repeat a source more than max_repeats (the budget exceeds the tokens that
    often), the exponent is 1."""
    n, plain = sources.agg(F.count("*"), F.sum(F.col("p") * F.log("p"))).first()
    if n < 2:
        return 1.0
    target = -plain + evenness * (math.log(n) + plain)
    by_entropy = _narrowed(sources, lambda z, zl, a, most: math.log(z) - a * zl / z >= target, True)
    if sources.agg(F.max(budget / n / F.col("t"))).first()[0] <= max_repeats:  # holds however even the mix is
        return round(by_entropy, 9)
    by_repeats = _narrowed(sources, lambda z, zl, a, most: most / z * budget <= max_repeats, False)
    return round(max(by_entropy, by_repeats), 9)


def quotas(totals: DataFrame, budget: int, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """totals (source key, t, n) with p, weight and quota. Sources without tokens get none."""
    total = totals.agg(F.sum("t")).first()[0] or 0
    live = totals.where("t > 0").withColumn("p", F.col("t") / F.lit(float(total or 1)))
    a = exponent(live, budget, evenness, max_repeats)
    z = live.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.pow("p", F.lit(a)) / F.lit(z)
    return live.withColumn("weight", weight).withColumn("quota", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))


def _key(source: str) -> Column:
    """The source as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def _mark(doc_id: str, text: str) -> Column:
    """What orders a source's documents at random: a hash of the id, or of the text where there is none, and after
    it a hash of the text, which tells rows with the same id apart."""
    own = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.concat(F.md5(F.coalesce(F.col(doc_id).cast("string"), own)), own)


def _range_of(mark: str, ranges: str) -> Column:
    return F.floor(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") * F.col(ranges) / F.lit(float(1 << 32))).cast("long")


def planned(slim: DataFrame, budget: int | None, evenness: float, max_repeats: float) -> tuple[DataFrame, DataFrame, int]:
    """(plan, ranges, budget) for slim (k, x, mark: source, tokens, order). plan: k, t, quota, ranges.
    ranges: k, r and starts, the tokens of the source before each hash range."""
    totals = written(slim.groupBy("k").agg(F.sum("x").alias("t"), F.count("*").alias("n")), "mixtotals")
    whole = totals.agg(F.sum("t")).first()[0] or 0
    budget = whole if budget is None else budget
    plan = quotas(totals, budget, evenness, max_repeats).select("k", "t", "quota", F.ceil(F.col("n") / RANGE).cast("long").alias("ranges"))
    plan = written(plan, "mixplan")
    sums = slim.join(plan, "k").groupBy("k", _range_of("mark", "ranges").alias("r")).agg(F.sum("x").alias("x"))
    earlier = F.sum("x").over(Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    return plan, written(sums.select("k", "r", F.coalesce(earlier, F.lit(0)).cast("long").alias("starts")), "mixranges"), budget


def mixture(docs: DataFrame, budget: int | None = None, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with one row for each copy, and mix_tokens, mix_epoch, mix_block and mix_slot.

    budget: tokens in all; None stands for as many as docs have. A copy starts before its source's quota
    ends, so a source exceeds it by less than its last document. mix_slot orders a block at random.

    A null source is a source of its own. Documents without tokens follow their source (and stay out where
    the whole source has none). Null ids are ordered by their text. Rows that are wholly equal count as
    often as they occur. Other columns stay as they are; if docs has columns of the names added here, the
    added ones get further underscores. An empty table gives an empty result.
    """
    names = docs.columns
    key, tokens, mark, n_of, part, before, epoch, block, slot, starts = (free_name(names, x) for x in ("__key", "mix_tokens", "__mark", "__ranges", "__range", "__before", "mix_epoch", "mix_block", "mix_slot", "__starts"))
    rows = docs.withColumns({key: _key(source), tokens: n_words(F.col(text)), mark: _mark(doc_id, text)})
    slim = written(rows.select(F.col(key).alias("k"), F.col(tokens).alias("x"), F.col(mark).alias("mark")), "mixslim")
    plan, ranges, budget = planned(slim, budget, evenness, max_repeats)
    n_blocks = max(1, -(-budget // block_tokens))
    placed = rows.join(plan.select(F.col("k").alias(key), F.col("ranges").alias(n_of)), key).withColumn(part, _range_of(mark, n_of))
    within = Window.partitionBy(key, part).orderBy(mark, tokens).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn(before, F.coalesce(F.sum(tokens).over(within), F.lit(0)).cast("long"))
    t, quota = free_name(names, "__t"), free_name(names, "__quota")
    full = ranges.join(plan, "k").select(F.col("k").alias(key), F.col("r").alias(part), F.col("starts").alias(starts), F.col("t").alias(t), F.col("quota").alias(quota))
    placed = placed.join(full, [key, part])
    at = F.col(starts) + F.col(before)
    whole_times = F.floor(F.col(quota) / F.col(t)).cast("long")
    copies = whole_times + F.when(at < F.col(quota) - whole_times * F.col(t), F.lit(1)).otherwise(F.lit(0))
    out = placed.where(copies > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    place = (F.col(epoch) * F.col(t) + at) / F.col(quota)
    return out.select(*names, tokens, epoch, F.floor(place * F.lit(float(n_blocks))).cast("long").alias(block), F.md5(F.concat_ws(":", mark, epoch)).alias(slot))


def mixed(docs: DataFrame, budget: int | None = None, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `mixture` with the columns of docs alone, without moving a text between tasks.

    Of each source only the place where its last, partial time through ends is worked out, from hashes and
    counts. A table of one row a source tells each document how often it stays; that table is broadcast
    where it has at most MAX_BROADCAST rows and joined by shuffle beyond. Only rows equal in id and text tie with
    the place in order; they stay in or out of the last time through together. Otherwise as in `mixture`. Rows
    come in the order of docs: blocks are left to `mixture`.
    """
    names = docs.columns
    key, mark, whole, cut = (free_name(names, x) for x in ("__key", "__mark", "__whole", "__cut"))
    slim = written(docs.select(_key(source).alias("k"), n_words(F.col(text)).alias("x"), _mark(doc_id, text).alias("mark")), "mixslim")
    plan, ranges, _ = planned(slim, budget, evenness, max_repeats)
    times = F.floor(F.col("quota") / F.col("t")).cast("long")
    plan = plan.withColumns({"times": times, "rest": F.col("quota") - times * F.col("t")})
    last = ranges.join(plan.select("k", "rest", "ranges"), "k").where("starts < rest").groupBy("k").agg(F.max(F.struct("r", "starts", "rest", "ranges")).alias("l"))
    last = written(last.select("k", "l.*"), "mixlast")
    inside = slim.join(last.select("k", "r", "starts", "rest", "ranges"), "k").where(_range_of("mark", "ranges") == F.col("r"))
    before = F.coalesce(F.sum("x").over(Window.partitionBy("k").orderBy("mark", "x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first_out = inside.withColumn("at", F.col("starts") + before).where("at >= rest").groupBy("k").agg(F.min("mark").alias("cut"))
    # where no document of the range is out, all up to the range's end stay: marks sort below the next range's first
    edge = F.lpad(F.lower(F.hex(F.ceil((F.col("r") + 1) * F.lit(float(1 << 32)) / F.col("ranges")).cast("long"))), 8, "0")
    ends = last.join(first_out, "k", "left").select("k", F.coalesce("cut", F.when(F.col("r") + 1 < F.col("ranges"), edge).otherwise("g")).alias("cut"))
    sources = written(plan.join(ends, "k", "left").select(F.col("k").alias(key), F.col("times").alias(whole), F.coalesce("cut", F.lit("")).alias(cut)), "mixsources")
    if sources.count() <= MAX_BROADCAST:
        sources = F.broadcast(sources)
    rows = docs.withColumns({key: _key(source), mark: _mark(doc_id, text)}).join(sources, key)
    copies = (F.col(whole) + (F.col(mark) < F.col(cut)).cast("long")).cast("int")
    return rows.where(copies > 0).withColumn(mark, F.explode(F.sequence(F.lit(1), copies))).select(*names)


def op3_rows(docs: DataFrame) -> DataFrame:
    got = mixture(docs.select("doc_id", "text", "source"))
    return got.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"))
