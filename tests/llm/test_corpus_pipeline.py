import re

import public_tokenizers

import corpus_pipeline
from ledgerlake.llm.quality_bayes import trained
from ledgerlake.llm.secret_scan import masked, scan
from ledgerlake.llm.sentencepiece_nbest import DEFAULT_MODEL, PieceLattice

from .test_near_jaccard import expected as near_groups
from .test_quality_bayes import plain as plain_quality
from .test_source_mixing import plain_exponent


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality classifier"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    kept = [r for r, p in zip(rows, plain_quality(rows, model)) if p >= 0.5]
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in kept) and len(kept) < len(rows)

    two = stage["SimHash near-dedup"](spark, one, sf_dir)
    of = near_groups([(r[0], r[1]) for r in kept])
    alone = [r for r in kept if of[r[0]] == r[0]]
    assert len(alone) < len(kept)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(r[0] for r in alone)

    three = stage["secret scans"](spark, two, sf_dir)
    assert three.columns == docs.columns
    clean = {r.doc_id: r for r in three.collect()}
    for r in alone:
        assert clean[r[0]].text == masked(r[1]) and not scan(clean[r[0]].text)
        assert clean[r[0]].n_chars == len(clean[r[0]].text)

    four = stage["mixing sources"](spark, three, sf_dir)
    assert four.columns == docs.columns
    words = {k: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for k, r in clean.items()}
    t = {}
    for s, n in words.values():
        t[s] = t.get(s, 0) + n
    want = dict(zip(sorted(t), plain_exponent([t[s] for s in sorted(t)], sum(t.values()), 0.5, 4.0)))
    used = {s: 0 for s in t}
    mixed = four.collect()
    for r in mixed:
        assert r.text == clean[r.doc_id].text
        used[r.source] += words[r.doc_id][1]
    for s in t:
        quota = round(want[s] * sum(t.values()))
        assert quota - 1 <= used[s] < quota + max(n for x, n in words.values() if x == s)

    pieces = PieceLattice(public_tokenizers.path(DEFAULT_MODEL))
    five = stage["SentencePiece encoding"](spark, four, sf_dir).collect()
    assert len(five) == len(mixed)
    for r in five[:40]:
        assert pieces.encode(clean[r.doc_id].text)[0].tolist() == r.ids
    assert all(r.round_trip for r in five)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert "ids" in got.columns and got.count() > 0


def test_odd_tables_go_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, further columns, and an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "web", 0), (None, "same text here", None, "web", 14), (None, "same text here", None, "web", 14), (10**6 + 1, "word " * 60_000, "de", None, 300_000), (10**6 + 1, "another text with that id", "de", None, 25)], docs.schema)
    for k, df in enumerate((docs.unionByName(odd).unionByName(docs.limit(5)).selectExpr("*", "1 as fp", "'x' as grp", "2 as mix_tokens"), docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        now = df
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, f"{tmp_path}/{k}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == df.columns
        assert (now.count() > 0) == (k == 0)
