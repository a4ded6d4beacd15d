"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of text features. It is learned from preference pairs
(a label-1 document is preferred to a label-0 document) by logistic loss on feature differences,
and the accept threshold is a quantile of the learned strengths.

Edge cases: a null text is scored as the empty text; an empty text gets the score of zero features;
null ids or ids without a label are scored but never learned from; an id whose labels disagree is left
out of learning; an id with several texts is learned from once, by the smallest of their features; without both labels every document scores 0.5; other columns pass through unread.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_crc_mod, table

#: At most so many labelled documents are learned from, those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
ACCEPT_SCORE = 0.3

_SYMBOLS = b"#$%&*|<>{}[]~^=+@\\_"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_BREAKS = b"!?"


def text_features(text: str | None) -> np.ndarray:
    """Features of one whole text, all finite; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(N_FEATURES)
    size, n = len(raw), len(words)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = share(_UPPER), share(_LOWER)
    repeats = sum(map(operator.eq, words, words[1:])) / n
    expected = min(1.0, 1.15 - 0.065 * np.log(n + 1))  # of distinct words in running text of this length
    base = [
        np.log1p(n) / 8,
        share(_SYMBOLS),
        upper / (upper + lower + 0.01),
        share(_DIGITS),
        share(_BREAKS),
        len(counts) / n - expected,
        max(counts.values()) / n,
        repeats,
        len(set(lines)) / len(lines),
        min(size / n, 40) / 10,
        sum(1 for x in lines if x.rstrip()[-1:] in b".!?:;\"'") / len(lines),
        min(n / len(lines), 400) / 100,
    ]
    bends = [np.sqrt(base[i]) for i in (1, 2, 3, 4, 6, 7)] + [base[5] ** 2, base[8] ** 2]
    return np.array([1.0, *base, *bends])


N_FEATURES = 21


@dataclass(frozen=True)
class RankingModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float  # strength at the accept quantile

    def strength(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """In (0, 1), rising with strength, ACCEPT_SCORE exactly at the threshold strength."""
        shift = np.log(ACCEPT_SCORE / (1 - ACCEPT_SCORE))
        return 1 / (1 + np.exp(-np.clip(self.strength(features) - self.threshold + shift, -50, 50)))


def fit_bradley_terry(features: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, rounds: int = 25) -> RankingModel:
    """Newton steps on the mean of log(1 + exp(-w.(x_preferred - x_other))) with a ridge."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    k = features.shape[1]
    if not len(good) or not len(bad):
        return RankingModel(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(ACCEPT_SCORE / (1 - ACCEPT_SCORE))))
    mean, scale = features.mean(0), features.std(0)
    scale[scale < 1e-9] = 1.0
    z = (features - mean) / scale
    draw = np.random.default_rng(7)
    diff = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        grad = ridge * w - diff.T @ p / len(diff)
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + (ridge + 1e-9) * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    cut = min(len(bad), len(s) - 1)  # the quantile at the share of rejected documents
    return RankingModel(mean, scale, w, float((s[cut - 1] + s[cut]) / 2))


def training_sample(labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row (doc_id, quality) for each labelled id outside the held-out fold, at most ``max_rows``."""
    return (
        labels.where(F.col("quality").isin(0, 1) & (id_crc_mod("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top"))
        .where(F.col("quality") == F.col("top"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> RankingModel:
    """Features of the sampled labelled documents go to the driver: ``max_rows`` x 21 doubles at most."""
    sample = training_sample(labels, max_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [text_features(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "f", "quality"])

    # max_rows ids with a label, 16 bytes each: small enough to broadcast at any corpus size
    rows_of = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    made = rows_of.mapInArrow(rows, "doc_id long, f array<double>, quality int")
    got = made.groupBy("doc_id").agg(F.min("f").alias("f"), F.first("quality").alias("quality")).orderBy("doc_id").toPandas()  # an id counts once
    if not len(got):
        return fit_bradley_terry(np.zeros((0, N_FEATURES)), np.zeros(0))
    return fit_bradley_terry(np.stack(got["f"].to_numpy()), got["quality"].to_numpy())


def score_documents(documents: DataFrame, model: RankingModel, score_column: str = "score") -> DataFrame:
    """``documents`` with a double column ``score_column``: one pass, no shuffle."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([text_features(t) for t in texts]).reshape(len(texts), N_FEATURES)))

    return documents.withColumn(score_column, scored(F.col("text")))


def accept(documents: DataFrame, model: RankingModel) -> DataFrame:
    """The documents at or above the threshold quantile, with their own columns only."""
    name = fresh(documents, "quality_score")
    return score_documents(documents, model, name).where(F.col(name) >= ACCEPT_SCORE).drop(name)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score_documents(documents.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(id_crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT_SCORE).cast("int").alias("predicted"),
    )
