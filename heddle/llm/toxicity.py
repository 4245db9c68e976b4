"""Toxicity: non-negative positive-unlabelled learning.

A linear classifier on the presence of words and word beginnings, and on beginnings that two or more
distinct words share, is trained in numpy from confirmed
toxic texts P and unlabelled texts U. With class prior pi and logistic loss the risk is

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),

and where the second term falls below zero its gradient is taken the other way, which keeps a flexible
model from fitting unlabelled toxic texts as negatives.

The training sets are bounded samples (the doc_ids of smallest hash): MAX_POSITIVE confirmed texts,
MAX_UNLABELLED texts; of rows that share a doc_id the least text stands for all. Everything else covers all rows;
scoring is a narrow map.

Defined results: null and empty texts have no features and get the score of the intercept; a document
with several labels counts as toxic if one says so; with no confirmed text, or no text at all, the score
is the class prior (0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.support import OUT_ROWS, load, rows_out

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
#: Hashed features: 2 ** BITS.
BITS = 18
SIZE = 1 << BITS
#: Word beginnings, in letters, that are features beside the word.
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    parts = [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [xxhash.xxh32_intdigest(p.encode(), 7) >> (32 - BITS) for p in parts]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def text_features(text: str | None) -> np.ndarray:
    """Distinct feature numbers: those of the words, and SIZE more for each that two distinct words have."""
    found = [f for w in words(text) for f in word_features(w)]
    ids, n = np.unique(np.array(found, np.uint32), return_counts=True)
    return np.concatenate((ids, ids[n > 1] + np.uint32(SIZE)))


class Linear:
    """Weights of 2 * SIZE features, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept, self._words = weights, intercept, {}

    def _ids(self, w: str) -> tuple[int, ...]:
        """The word's features that have a weight, by themselves or twice."""
        if (x := self._words.get(w)) is None:
            if len(self._words) > 500_000:  # a bound on memory, not on words
                self._words.clear()
            x = self._words[w] = tuple(f for f in set(word_features(w)) if self.weights[f] or self.weights[f + SIZE])
        return x

    def margin(self, ids: np.ndarray) -> float:
        return self.intercept + float(self.weights[ids].sum(dtype=np.float64))

    def score(self, text: str | None) -> float:
        n = Counter(f for w in words(text) for f in self._ids(w))
        z = self.margin(np.array(sorted(f + k for f, c in n.items() for k in ((0, SIZE) if c > 1 else (0,))), np.int64))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def __getstate__(self):
        used = np.flatnonzero(self.weights)
        return used.astype(np.uint32), self.weights[used], len(self.weights), self.intercept

    def __setstate__(self, state):
        used, values, size, self.intercept = state
        self.weights, self._words = np.zeros(size, np.float32), {}
        self.weights[used] = values


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, shrink: float = 1e-4, least: int = 3) -> Linear:
    """Full-batch proximal Adam on the non-negative risk, over features of `least` texts that tell P from U."""
    size = 2 * SIZE
    if not positive or not unlabelled or prior <= 0:
        return Linear(np.zeros(size, np.float32), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-50.0 if prior <= 0 else 50.0))
    common = np.flatnonzero(_telling(positive, unlabelled, size, least))
    place = np.full(size, -1, np.int32)
    place[common] = np.arange(len(common))
    rows = [place[i][place[i] >= 0] for r in (positive, unlabelled) for i in r]
    at = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p, n, w, b = len(positive), len(rows), np.zeros(len(common)), float(np.log(prior / (1 - prior)))
    is_p = np.arange(n) < p
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[at], n) + b
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        as_negative = np.logaddexp(0, z)  # the loss of calling a text clean
        rest = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
        minus = np.where(is_p, -prior * s / p, s / (n - p))
        plus = np.where(is_p, -prior * (1 - s) / p, 0.0)
        g = plus + minus if rest >= 0 else -minus
        gw, gb = np.bincount(at, g[doc], len(common)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        k = rate / (1 - 0.9**t)
        scale = np.sqrt(v / (1 - 0.999**t)) + 1e-8
        w = w - k * m / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * shrink / scale)
        b -= k * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[common] = w
    return Linear(weights, b)


def _telling(positive, unlabelled, size: int, least: int, z: float = 2.5) -> np.ndarray:
    """Features of at least `least` texts whose shares in P and U differ by z standard errors."""
    a, u = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for n, rows in ((a, positive), (u, unlabelled)):
        for ids in rows:  # a text has each number once
            n[ids] += 1
    q = (a + u) / (len(positive) + len(unlabelled))
    error = np.sqrt(np.maximum(q * (1 - q), 1e-12) * (1 / len(positive) + 1 / len(unlabelled)))
    return (np.abs(a / len(positive) - u / len(unlabelled)) >= z * error) & (a + u >= least)


def prior_bound(model: Linear, positive, unlabelled) -> float:
    """The largest class prior that the unlabelled texts allow: at no threshold can toxic texts alone outnumber the texts above it."""
    p, u = (np.array([model.margin(i) for i in rows]) for rows in (positive, unlabelled))
    above = [(float((u >= t).mean()), float((p >= t).mean())) for t in np.quantile(p, np.linspace(0.02, 0.6, 30))]
    # less a standard error for the share of the confirmed texts, which may be few
    return min(x / max(y - (y * (1 - y) / len(p)) ** 0.5, 1e-9) for x, y in above)


def learn_model(positive, unlabelled, prior: float) -> Linear:
    """Fits with the prior seen in the labels, lowers it where the unlabelled texts bound it, and fits again."""
    model = fit(positive, unlabelled, prior)
    if positive and unlabelled and 0 < (bound := prior_bound(model, positive, unlabelled)) < prior:
        model = fit(positive, unlabelled, bound)
    return model


_FEATURES = pa.schema([("positive", pa.bool_()), ("ids", pa.binary())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each():
        for b in batches:
            for positive, text in zip(b["positive"].to_pylist(), b["text"], strict=True):
                yield positive, text_features(text.as_py()).tobytes()

    return rows_out(_FEATURES, each())


def train(documents: DataFrame, labels: DataFrame, learn: Column) -> Linear:
    """A classifier from the documents (doc_id, text) for which `learn` holds; labels: doc_id, toxic."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = documents.select("doc_id", "text").where(learn)
    ids = docs.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left").withColumn("pick", F.xxhash64("doc_id", F.lit("pu")))
    n = ids.agg(F.count("toxic").alias("known"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    prior = min(0.95, n["toxic"] / n["known"]) if n["known"] else 0.0
    take = lambda d, k, positive: d.orderBy("pick", "doc_id").limit(k).select("doc_id", F.lit(positive).alias("positive"))
    chosen = take(ids.where("toxic = 1"), MAX_POSITIVE, True).unionByName(take(ids, MAX_UNLABELLED, False))
    sample = docs.join(F.broadcast(chosen), "doc_id")  # at most MAX_POSITIVE + MAX_UNLABELLED distinct ids
    sample = sample.groupBy("positive", "doc_id").agg(F.min("text").alias("text")).select("positive", "text")
    rows = sorted(map(tuple, sample.mapInArrow(_features, "positive boolean, ids binary").toLocalIterator()))  # one partition at a time
    as_arrays = lambda positive: [np.frombuffer(i, np.uint32) for p, i in rows if p == positive]
    return learn_model(as_arrays(True), as_arrays(False), prior)


def scored(documents: DataFrame, model: Linear, column: str = "score") -> DataFrame:
    """All rows and columns of documents, and `column`: the probability that `text` is toxic."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 * SIZE weights at most
    at = documents.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(i, OUT_ROWS)
                scores = pa.array([m.score(t.as_py()) for t in part.column(at)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*names, column])

    names = documents.columns
    schema = T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())])
    return documents.mapInArrow(run, schema)


def learns(column: str = "doc_id") -> Column:
    """Rows whose labels may be learnt: crc32 of doc_id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4, F.lit(0)) != 2


def op10_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, by a model of the texts and labels of the training rows."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = train(docs, load(spark, sf_dir, "labels"), learns())
    out = scored(docs, model)
    return out.select("doc_id", (~learns()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_nnpu_toxicity": op10_nnpu_toxicity}
ORACLES: dict[str, str] = {}
