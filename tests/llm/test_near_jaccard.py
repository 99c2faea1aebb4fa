import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import near_jaccard
from ledgerlake.llm.common import written
from ledgerlake.llm.near_jaccard import _close, _read_sketch, long_sketch, sketch
from ledgerlake.llm.simhash_golay import fingerprint, keep_one_of_each, simhash_groups

from .test_simhash_golay import components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    prints = {i: fingerprint(t or "") for i, t in rows}
    sets = {i: plain_set(t) for i, t in rows}
    return components(sorted(sets), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0)


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_edited_copies_are_linked_as_by_brute_force(spark):
    rng = random.Random(8)
    texts, line = [None, "", "one two", "One TWO"], " ".join(f"licence{k}" for k in range(9))
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 60, 200, 700)))]
        texts += [edited(rng, words, n) + (f" {line}" if k % 3 == 0 else "") for n in (0, 1, 1, len(words) // 60, len(words) // 40, len(words) // 30)]
    texts += [f"{line} {k}" for k in range(30)] + [line, f"{line} {line}"]
    words = [f"h{rng.randrange(5000)}" for _ in range(150)]
    texts += [edited(rng, words, rng.choice((1, 2, 3, 4))) for _ in range(40)]  # more than a list pairs off
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    got = {r.doc_id: r.component_id for r in simhash_groups(df, similar=True).collect()}
    assert got == want
    assert len(set(want.values())) < len({r.component_id for r in simhash_groups(df).collect()})
    kept = keep_one_of_each(df, similar=True)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert keep_one_of_each(df.limit(0), similar=True).count() == 0


def test_sketches_rule_out_nothing_similar():
    rng = np.random.default_rng(2)
    for _ in range(400):
        x = rng.integers(-(1 << 63), 1 << 63, rng.integers(1, 900))
        y = np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 90))])
        apart = len(set(x.tolist()) ^ set(y.tolist()))
        assert np.bitwise_count((sketch(x) ^ sketch(y)).view(np.uint64)).sum() <= apart


def test_long_sketches_rule_out_nothing_similar_and_long_unlike_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 90, 700, 4000, 9000):
        for share in (0.8, 0.85, 0.9, 1):
            x = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
            for y in (x[: max(1, -(-int(100 * share) * n // 100))], np.concatenate([x, rng.integers(-(1 << 63), 1 << 63, n // 4)])):
                assert 9 * len(np.intersect1d(x, y)) < 4 * (len(x) + len(y)) or _close(_read_sketch(long_sketch(x)), _read_sketch(long_sketch(y)))
        y = rng.integers(-(1 << 63), 1 << 63, n)
        assert n < 90 or not _close(_read_sketch(long_sketch(x)), _read_sketch(long_sketch(y)))


def test_long_texts_that_share_a_line_alone_do_not_move(spark, monkeypatch):
    rng = random.Random(6)
    seen = {}

    def spied(df, label, path=None):
        out = written(df, label, path)
        seen[label] = seen.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(near_jaccard, "written", spied)
    texts = [" ".join([*(f"w{rng.randrange(5000)}" for _ in range(3000)), *(f"line{k // 2}x{j}" for j in range(8))]) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_groups(df, similar=True).collect()}
    assert got == {k: k for k in range(20)}
    assert seen["jaccardpairs"] >= 10 and seen["jaccardclose"] == 0


def test_portions_change_no_group(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"h{rng.randrange(5000)}" for _ in range(150)]
    rows = list(enumerate([edited(rng, words, rng.choice((1, 2, 3, 4))) for _ in range(30)]))
    labels = []
    monkeypatch.setattr(near_jaccard, "LEAST_MOVED", 1)
    monkeypatch.setattr(near_jaccard, "MOVED", 0.5)
    monkeypatch.setattr(near_jaccard, "LISTED", 0.03)
    monkeypatch.setattr(near_jaccard, "DEALT", 4)
    monkeypatch.setattr(near_jaccard, "written", lambda df, label, path=None: labels.append(label) or written(df, label, path))
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), similar=True).collect()}
    assert got == expected(rows)
    assert labels.count("jaccardgood") > 2 and labels.count("jaccardmet") > 1


def test_written_tables_leave_no_shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    kept = [written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test") for _ in range(3)]
    assert [df.count() for df in kept] == [7, 7, 7]
    assert tracker.shuffleStatuses().size() <= before + 3  # those of the counts above


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, edited(rng, words, 5)), (3, "another text of its own")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]
