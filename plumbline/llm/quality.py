"""Quality classifier: hashed word n-gram logistic regression learned by FTRL-proximal.

A text is a sequence of tokens: words and runs of symbols. Its features are the hashed
1- and 2-grams of the lower-cased tokens and the 1- to 3-grams of their shapes (case,
digits, the symbol itself), each with value log(1 + count), scaled to length one. Scores
are sparse dot products with the learned weights through the logistic function.

fit() learns from a bounded sample of labelled rows, TRAIN_DOCS of each class, whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, learnable, prepare, slices

BITS = 18
TRAIN_DOCS = 1500  # of each class
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1.0
THRESHOLD = 0.7

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(token: str) -> str:
    if token[0].isalpha():
        return "X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() else "x" if token.islower() else "xX"
    return "9" if token[0].isdigit() else token[:3]


class Features:
    """Hashed n-gram rows of texts; what a token hashes to is kept between texts."""

    KEPT = 300_000

    def __init__(self) -> None:
        self.kept: dict[str, tuple[int, int]] = {}

    def _hash(self, token: str) -> tuple[int, int]:
        if len(self.kept) >= self.KEPT:
            self.kept.clear()
        found = self.kept[token] = (xxhash.xxh64_intdigest("w" + token.lower()), xxhash.xxh64_intdigest("s" + _shape(token)))
        return found

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of all features of a list of texts, sorted by text and feature."""
        lists = [TOKEN.findall(t) if t else [] for t in texts]
        lens = np.array([len(x) for x in lists], dtype=np.int64)
        flat = [t for x in lists for t in x]
        if not flat:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        codes, unique = pd.factorize(np.array(flat, dtype=object))
        pair = np.array([self.kept.get(t) or self._hash(t) for t in unique], dtype=np.uint64)
        word, shape = pair[codes, 0], pair[codes, 1]
        of = np.repeat(np.arange(len(texts)), lens)
        k = np.uint64(0x9E3779B97F4A7C15)

        def rows(h: np.ndarray, kind: int) -> np.ndarray:
            h = (h ^ np.uint64(kind)) * k
            return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)

        same = of[1:] == of[:-1]
        same3 = of[2:] == of[:-2]
        keys = [(of, rows(word, 1)), (of[1:][same], rows(word[:-1] * k + word[1:], 2)[same]), (of, rows(shape, 3)), (of[1:][same], rows(shape[:-1] * k + shape[1:], 4)[same]), (of[2:][same3], rows((shape[:-2] * k + shape[1:-1]) * k + shape[2:], 5)[same3])]
        joint, count = np.unique(np.concatenate([o.astype(np.uint64) << np.uint64(BITS) | r for o, r in keys]), return_counts=True)
        doc, feature = (joint >> np.uint64(BITS)).astype(np.int64), (joint & np.uint64((1 << BITS) - 1)).astype(np.int64)
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
        return doc, feature, value / norm[doc]


class FTRL:
    """Follow the regularised leader: per-coordinate rates, L1 for sparse weights."""

    def __init__(self, size: int) -> None:
        self.z, self.n, self.bias_z, self.bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0

    def _weights(self, z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, rows: np.ndarray, values: np.ndarray, y: float, weight: float) -> None:
        z, n = self.z[rows], self.n[rows]
        w = self._weights(z, n)
        bias = -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA + L2)
        g0 = (1 / (1 + np.exp(-np.clip(w @ values + bias, -35, 35))) - y) * weight
        g = g0 * values
        self.z[rows] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g
        self.bias_z += g0 - ((self.bias_n + g0 * g0) ** 0.5 - self.bias_n**0.5) / ALPHA * bias
        self.bias_n += g0 * g0

    def result(self) -> tuple[np.ndarray, float]:
        return self._weights(self.z, self.n), -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA + L2)


Model = tuple[np.ndarray, float]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], shares: tuple[float, float], seed: int = 3) -> Model:
    """examples: (rows, values, label). shares: the true counts of labels 0 and 1, which weigh the classes.

    With no example the model scores 0.5; with one class only, as learned from it.
    """
    learner, rng = FTRL(1 << BITS), np.random.default_rng(seed)
    have = [sum(1 for e in examples if e[2] == c) for c in (0, 1)]
    # Rare rejections cost as much as keeps: between the sample's equal weights and the true shares.
    total = sum(shares) or 1.0
    weight = [(shares[c] / total) ** 0.5 * len(examples) / max(1, have[c]) / 2 for c in (0, 1)]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            rows, values, y = examples[i]
            learner.learn(rows, values, float(y), weight[y])
    return learner.result()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn labels.quality from texts of rows that learnable() lets through.

    Labels other than 0 and 1, null ids and labels without a text are skipped; a document with
    both labels is learned once with each, and one with several texts once with each of them.
    """
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where(learnable(F.col("id")) & F.col("y").isin(0, 1)).distinct()
    shares = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    rank = W.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    ids = F.broadcast(marks.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= TRAIN_DOCS).select("id", "y"))  # 2 * TRAIN_DOCS rows
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id").withColumn("id", F.col("id").cast("string")).where(F.col("text").isNotNull())

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in slices(texts):
                doc, feature, value = make(texts[lo:hi])
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pd.DataFrame({"id": b["id"].iloc[lo:hi].tolist(), "y": b["y"].iloc[lo:hi].tolist(), "rows": [feature[p:q].tolist() for p, q in zip(cuts, cuts[1:])], "vals": [value[p:q].tolist() for p, q in zip(cuts, cuts[1:])]})

    found = rows.mapInPandas(hashed, "id string, y int, rows array<int>, vals array<float>").orderBy("id").collect()  # a bounded sample
    return train([(np.array(r.rows, dtype=np.int64), np.array(r.vals), r.y) for r in found], (float(shares.get(0, 0)), float(shares.get(1, 0))))


def _judge(spark: SparkSession, model: Model):
    """A column function: text -> struct(score, predicted)."""
    prepare(spark)
    held = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2^BITS weights

    @F.pandas_udf("score double, predicted int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make = Features()
        weights, bias = held.value
        for b in batches:
            texts = b.tolist()
            s = np.full(len(texts), float(bias))
            for lo, hi in slices(texts):
                doc, feature, value = make(texts[lo:hi])
                s[lo:hi] += np.bincount(doc, weights[feature] * value, hi - lo)
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pd.DataFrame({"score": p, "predicted": (p >= THRESHOLD).astype("int32")})

    return judge.asNondeterministic()  # computed once for each row


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row's whole text.

    Null and empty texts get the model's bias. Repeated rows score alike; a null doc_id is
    not held out; other columns are not read.
    """
    judge = _judge(docs.sparkSession, model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judge(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", "p.score", "p.predicted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs predicted as 1, with all their columns."""
    judge = _judge(docs.sparkSession, model)
    rows = docs.select(F.struct(*docs.columns).alias("row"), judge(F.col("text").cast("string")).alias("p"))
    return rows.where("p.predicted = 1").select("row.*")
