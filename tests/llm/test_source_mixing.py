import math
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlake.llm.source_mixing import mixed, mixture, op3_rows, quotas


def plain_exponent(t, budget, evenness, max_repeats):
    total = sum(t)
    p = [x / total for x in t]

    def w(a):
        z = sum(x**a for x in p)
        return [x**a / z for x in p]

    natural = -sum(x * math.log(x) for x in p)
    target = natural + evenness * (math.log(len(t)) - natural)
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        good = -sum(x * math.log(x) for x in w(mid)) >= target
        low, high = (mid, high) if good else (low, mid)
    a = low
    if max(x * budget / y for x, y in zip(w(a), t)) > max_repeats:
        low, high = a, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            good = max(x * budget / y for x, y in zip(w(mid), t)) <= max_repeats
            low, high = (low, mid) if good else (mid, high)
        a = high
    return w(a)


def test_weights_meet_the_targets(spark):
    for t, budget, limit in (([5000, 300, 20, 7], 5327, 4.0), ([5000, 300, 20, 7], 5327, 1.5), ([10, 10], 20, 4.0), ([9], 9, 4.0), ([100, 1], 1000, 2.0)):
        df = spark.createDataFrame([(str(k), x, 1) for k, x in enumerate(t)], "k string, t long, n long")
        got = {r.k: r.weight for r in quotas(df, budget, 0.5, limit).collect()}
        want = plain_exponent(t, budget, 0.5, limit)
        assert all(abs(got[str(k)] - x) < 1e-7 for k, x in enumerate(want))


def test_realised_copies_fill_the_quotas(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in docs.collect()}
    t = Counter()
    for s, n in words.values():
        t[s] += n
    order = sorted(t)
    want = dict(zip(order, plain_exponent([t[s] for s in order], sum(t.values()), 0.5, 4.0)))
    got = op3_rows(docs).collect()
    used, last = Counter(), Counter()
    for r in got:
        assert words[r.doc_id] == (r.source, r.n_tokens)
        used[r.source] += r.n_tokens
        last[r.source] = max(last[r.source], r.n_tokens)
    for s in order:
        quota = round(want[s] * sum(t.values()))
        assert quota <= used[s] + 1 and used[s] < quota + max(n for x, n in words.values() if x == s)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert len({r.slot for r in got}) == len(got)


def test_blocks_hold_each_source_in_proportion(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[min(2, i // 3000)]) for i in range(4000)], "doc_id long, text string, source string")
    got = mixture(docs, block_tokens=4000).groupBy("mix_block", "source").agg(F.sum("mix_tokens").alias("n")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r.n)
    for n in by.values():
        assert len(n) == 10 and max(n) - min(n) <= 20


def test_mixed_rows_are_those_of_the_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for budget, even in ((None, 0.5), (1_000, 1.0), (300_000, 0.9), (7, 0.0)):
        want = mixture(docs, budget, even, 100.0).select(docs.columns)
        got = mixed(docs, budget, even, 100.0)
        assert got.columns == docs.columns
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in want.collect())


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (2, "", "a", 6), (None, "x y", "a", 7), (None, "x y", "a", 7), (3, "w " * 50_000, "b", 8), (4, None, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch int")
    got = mixture(df)
    assert got.columns[:4] == df.columns and "mix_epoch_" in got.columns
    kept = got.collect()
    assert {r.source for r in kept} == {"a", "b"}
    assert sum(r.text == "x y" for r in kept) % 2 == 0
    assert mixture(df.limit(0)).count() == 0
    thin = mixed(df)
    assert thin.columns == df.columns and {r.source for r in thin.collect()} == {"a", "b"}
    assert mixed(df.limit(0)).count() == 0
