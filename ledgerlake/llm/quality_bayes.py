"""Quality by hierarchical empirical Bayes: a document classifier with host and path priors.

A logistic model over a few text statistics gives each document evidence of its own. The evidence is
summed by path (host and language here) and by host with grouped aggregates. Variance components of
those sums set how strongly a site is shrunk: hosts towards the whole corpus, paths towards their host,
sparse ones most. A path's shrunken mean is the prior of its documents, and evidence and prior combine
as log odds.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, enter, free_name, written

#: Labelled documents the model is fitted on at most: those whose ids have the smallest hashes.
MAX_TRAINING = 20_000
#: Paths up to which their table is broadcast; more are joined by shuffle.
MAX_BROADCAST = 50_000
#: A document is kept from this probability on.
KEEP = 0.5
RIDGE = 1.0
FEATURES = ("log_words", "distinct", "repeated", "symbols", "digits", "stops", "word_length", "lines_repeated", "short")
_SYMBOLS = "%$&#*@^~|<>{}[]\\=_+"


def features(text: str) -> list[float]:
    """Statistics of a whole text, in the order of FEATURES."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lines = text.split("\n")
    return [
        math.log1p(n), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, sum(map(text.count, _SYMBOLS)) / chars,
        sum(map(text.count, "0123456789")) / chars, sum(map(text.count, ".,;:!?")) / n, (chars - n + 1) / n,
        1 - len(set(lines)) / len(lines), float(n < 5),
    ]


def with_features(docs: DataFrame, text: str, keep: tuple[str, ...], name: str = "features") -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [features(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.list_(pa.float64()))], names=[*keep, name])

    got = docs.select(*keep, as_text(text).alias(free_name(list(keep), "__text")))
    return got.mapInArrow(run, T.StructType([*got.schema.fields[: len(keep)], T.StructField(name, T.ArrayType(T.DoubleType()))]))


class Model:
    """A logistic model on standardised features: weights for raw features, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float, base: float):
        self.weights, self.intercept, self.base = weights, intercept, base

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights + self.intercept, -30, 30)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Model:
    """Newton's method with a ridge. With fewer than two classes the smoothed share of good labels stands."""
    good = float(y.sum())
    base = (good + 1) / (len(y) + 2)
    if good in (0.0, float(len(y))):
        return Model(np.zeros(len(FEATURES)), math.log(base / (1 - base)), base)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    pull = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return Model(weights, float(w[-1] - mean @ weights), base)


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_TRAINING) -> Model:
    """A model from at most `most` labelled documents. Labels other than 0 and 1, labels of unknown
    documents and null ids are left out; of contradicting labels the lower one counts. No more than
    `most` feature rows for each id reach the driver (a repeated document counts once)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = with_features(rows, "text", ("doc_id", "quality")).groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    x = np.array([r.r.features for r in got], float).reshape(-1, len(FEATURES))
    return fitted(x, np.array([r.r.quality for r in got], float))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None, name: str = "logit") -> DataFrame:
    """The columns `keep` (None: all) with the log odds of each document's own evidence."""
    keep = tuple(docs.columns) if keep is None else keep
    weights, intercept = model.weights, model.intercept

    def run(batches):
        enter("quality")
        own = Model(weights, intercept, 0.5)
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(len(keep))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(own.logit(x))], names=[*keep, name])

    got = docs.select(*keep, as_text(text).alias(free_name([*keep, name], "__text")))
    return got.mapInArrow(run, T.StructType([*got.schema.fields[: len(keep)], T.StructField(name, T.DoubleType())]))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame) -> float:
    """Pseudo-documents by which groups (n, s, q: count, sum, sum of squares) are shrunk: the variance
    within groups over that between them, by the one-way analysis of variance."""
    r = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r.n or r.g < 2 or r.n <= r.g:
        return 1e6
    within = max((r.q - r.m) / (r.n - r.g), 1e-9)
    spread = (r.m - r.s * r.s / r.n - (r.g - 1) * within) / (r.n - r.nn / r.n)
    return min(1e6, within / spread) if spread > 0 else 1e6


def posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, host_posterior, path_posterior) from evidence (host, path, p)."""
    paths = written(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "qualitypaths")
    hosts = written(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))), "qualityhosts")
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0] or 0.5
    up, down = _strength(hosts), _strength(paths)
    host = hosts.select("host", ((F.col("s") + F.lit(up * total)) / (F.col("n") + F.lit(up))).alias("host_posterior"))
    path = (F.col("s") + F.lit(down) * F.col("host_posterior")) / (F.col("n") + F.lit(down))
    return written(paths.join(host, "host").select("host", "path", "host_posterior", path.alias("path_posterior")), "qualityposteriors")


def _sites(df: DataFrame, host: str, path: tuple[str, ...]) -> tuple[Column, Column]:
    """Host and path as text; null values are sites of their own."""
    def one(c):
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))

    return one(host), F.concat_ws("/", *map(one, path))


def _posterior(model: Model) -> Column:
    odds = F.col("logit") - F.lit(math.log(model.base / (1 - model.base))) + _logit(F.col("path_posterior"))
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(doc_id, doc_score, host_posterior, path_posterior, posterior, keep), one row for each row of docs.

    Null and empty texts have the evidence of an empty document. A null host or path is a site of its own.
    Null ids and repeated rows are rows like any other; other columns are ignored.
    """
    h, p = _sites(docs, host, path)
    slim = scored(docs.select(F.col(doc_id).alias("doc_id"), h.alias("host"), p.alias("path"), F.col(text).alias("text")), model, "text", ("doc_id", "host", "path"))
    slim = written(slim.withColumn("p", 1 / (1 + F.exp(-F.col("logit")))), "qualityscores")
    got = slim.join(posteriors(slim), ["host", "path"]).withColumn("posterior", _posterior(model))
    return got.select("doc_id", F.col("p").alias("doc_score"), "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= KEEP).alias("keep"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", host: str = "source", path: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The rows of docs that `quality` keeps, with the columns of docs.

    Documents are scored again rather than shuffled with their texts: the table of sites is broadcast where
    it has at most MAX_BROADCAST rows and joined by shuffle beyond.
    """
    h, p = _sites(docs, host, path)
    slim = scored(docs.select(h.alias("host"), p.alias("path"), F.col(text).alias("text")), model, "text", ("host", "path"))
    sites = posteriors(slim.withColumn("p", 1 / (1 + F.exp(-F.col("logit")))))
    names = docs.columns
    site_h, site_p, own = (free_name(names, x) for x in ("__host", "__path", "__logit"))
    sites_ = sites.select(F.col("host").alias(site_h), F.col("path").alias(site_p), "path_posterior")
    if sites.count() <= MAX_BROADCAST:
        sites_ = F.broadcast(sites_)
    prior = free_name([*names, own], "__prior")
    sites_ = sites_.withColumnRenamed("path_posterior", prior)
    got = scored(docs.withColumns({site_h: h, site_p: p}), model, text, name=own).join(sites_, [site_h, site_p])
    odds = F.col(own) - F.lit(math.log(model.base / (1 - model.base))) + _logit(F.col(prior))
    return got.where(1 / (1 + F.exp(-odds)) >= KEEP).select(*names)
