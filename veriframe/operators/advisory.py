"""Advisory ranking of reviewed pairs: a small logistic model with a holdout by group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, RATE, DECAY = 350, 0.25, 0.02
#: Reviewed rows that are learned from at most, those with the smallest hash of their group and id.
MAX_ROWS = 20_000
# The least data for which a model is given.
LEAST = {"rows": 40, "positive": 12, "negative": 12, "groups": 4}


@dataclass(frozen=True)
class AdvisoryModel:
    weights: tuple[float, ...]
    held_out_groups: tuple
    training_rows: int


def fit(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Full-batch steps from zero; the first weight is the bias and does not decay. Eight decimals are kept."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    decay = np.full(len(w), DECAY)
    decay[0] = 0
    for _ in range(STEPS):
        w = w - RATE * (x.T @ (1 / (1 + np.exp(-(x @ w))) - labels) / len(x) + decay * w)
    return np.round(w, 8)


def train(reviews: DataFrame, features: Sequence[str], max_rows: int = MAX_ROWS) -> AdvisoryModel | None:
    """reviews(group, id, label, features); None where there are too few. A quarter of the groups, those with the
    smallest hash, is held out. The driver gets at most ``max_rows`` rows."""
    order = F.sha2(F.col("group").cast("string"), 256)
    facts = reviews.agg(F.count("*").alias("rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive"), F.count_distinct("group").alias("groups")).first()
    if facts["rows"] < LEAST["rows"] or facts["positive"] < LEAST["positive"] or facts["rows"] - facts["positive"] < LEAST["negative"] or facts["groups"] < LEAST["groups"]:
        return None
    groups = reviews.select("group", order.alias("h")).distinct().orderBy("h").limit(max(1, min(facts["groups"], max_rows) // 4)).collect()
    held = tuple(r["group"] for r in groups)
    rows = reviews.where(~F.col("group").isin(*held)).orderBy(order, "id").limit(max_rows).select("label", *features).toPandas()
    weights = fit(rows[list(features)].to_numpy(float), rows["label"].to_numpy(float))
    return AdvisoryModel(tuple(map(float, weights)), held, len(rows))


def with_scores(rows: DataFrame, model: AdvisoryModel, features: Sequence[str], into: str = "advice") -> DataFrame:
    logit = F.lit(model.weights[0])
    for w, f in zip(model.weights[1:], features, strict=True):
        logit = logit + F.col(f) * w
    return rows.withColumn(into, 1 / (1 + F.exp(-logit)))


def evaluation(rows: DataFrame, model: AdvisoryModel, features: Sequence[str]) -> DataFrame:
    """Confusion counts, precision (null without a positive call), recall and Brier score on the held-out groups."""
    scored = with_scores(rows.where(F.col("group").isin(*model.held_out_groups)), model, features)
    said, true = F.col("advice") >= 0.5, F.col("label") == 1
    counts = scored.agg(
        F.count_if(said & true).alias("true_positive"), F.count_if(said & ~true).alias("false_positive"), F.count_if(~said & true).alias("false_negative"),
        F.count_if(~said & ~true).alias("true_negative"), F.round(F.avg((F.col("advice") - F.col("label")) ** 2), 8).alias("brier"),
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 8))
    return counts.withColumns({"precision": share("true_positive", "false_positive"), "recall": share("true_positive", "false_negative")})
