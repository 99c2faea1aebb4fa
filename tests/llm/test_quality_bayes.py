import math

import numpy as np

from ledgerlake.llm.quality_bayes import Model, features, fitted, keep_good, quality, trained


def plain(rows, model):
    """rows: (doc_id, text, lang, source) -> posterior by row, by loops."""
    logit = [float(model.logit(np.array([features(t or "")]))[0]) for _, t, _, _ in rows]
    p = [1 / (1 + math.exp(-x)) for x in logit]

    def grouped(keys):
        out = {}
        for k, x in zip(keys, p):
            out.setdefault(k, []).append(x)
        return out

    def strength(groups):
        n = sum(map(len, groups))
        if len(groups) < 2 or n <= len(groups):
            return 1e6
        within = max(sum(sum((x - sum(g) / len(g)) ** 2 for x in g) for g in groups) / (n - len(groups)), 1e-9)
        mean = sum(p) / n
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups)
        spread = (between - (len(groups) - 1) * within) / (n - sum(len(g) ** 2 for g in groups) / n)
        return min(1e6, within / spread) if spread > 0 else 1e6

    hosts, paths = grouped([r[3] for r in rows]), grouped([(r[3], r[2]) for r in rows])
    up, down, mean = strength(list(hosts.values())), strength(list(paths.values())), sum(p) / len(p)
    host = {h: (sum(g) + up * mean) / (len(g) + up) for h, g in hosts.items()}
    path = {k: (sum(g) + down * host[k[0]]) / (len(g) + down) for k, g in paths.items()}

    def odds(x):
        x = min(max(x, 1e-9), 1 - 1e-9)
        return math.log(x / (1 - x))

    return [1 / (1 + math.exp(-(x - odds(model.base) + odds(path[r[3], r[2]])))) for x, r in zip(logit, rows)]


def test_posteriors_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = dict(zip([r[0] for r in rows], plain(rows, model)))
    got = quality(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.posterior - want[r.doc_id]) < 1e-6
        assert r.keep == (r.posterior >= 0.5)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.keep}


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = trained(docs, labels.where("doc_id % 2 = 0"))
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.keep for r in quality(docs, model).collect() if r.doc_id in held}
    assert sum(got[k] == bool(v) for k, v in held.items()) / len(held) > 0.95


def test_sparse_sites_are_shrunk_most(spark):
    model = Model(np.array([0, 0, 0, -200.0, 0, 0, 0, 0, 0]), 2.0, 0.5)
    good, bad = "plain words of a text", "$$ %% ## @@ && ** $$"
    rows = [(k, good, "en", "a") for k in range(200)] + [(1000 + k, bad if k % 2 else good, "en", "b") for k in range(200)] + [(2000, bad, "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality(df, model).collect()}
    assert got[0].path_posterior > got[2000].path_posterior > 0.1
    assert abs(got[1000].path_posterior - 0.45) < 0.1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, 1.0), (None, "", "en", "a", 2.0), (None, "", "en", "a", 2.0), (2, "w " * 50_000, None, "a", 3.0), (3, "fine words here", "", "", 4.0)], "doc_id long, text string, lang string, source string, logit double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = trained(df, labels)
    got = quality(df, model).collect()
    assert len(got) == 5 and all(0 <= r.posterior <= 1 for r in got)
    assert keep_good(df, model).columns == df.columns
    assert quality(df.limit(0), model).count() == 0 and keep_good(df.limit(0), model).count() == 0
    assert fitted(np.zeros((0, 9)), np.zeros(0)).base == 0.5
    assert quality(df, trained(df, labels.limit(0))).count() == 5
