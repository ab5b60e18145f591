"""Quality classifier: naive Bayes support vectors (operator 5).

N-gram indicators are scaled by the log ratio of their smoothed rates in the two classes, counted over all labelled
rows that may be learned from.  A linear hinge-loss model on them is fitted by dual coordinate descent on a sample of
at most ``SAMPLE`` of those rows; a quarter of the sample calibrates its margins to probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import id_remainder, stored
from tidelog.llm.features import BUCKETS, class_counts, featured, labelled, sample, scored, stylistic

#: Labelled rows the model is fitted on, at most about; counts are over all of them.
SAMPLE = 12_000
#: A feature counts if at least so many labelled rows have it.
LEAST_ROWS = 5
SMOOTH = 1.0
COST, EPOCHS = 0.05, 12
HELD_OUT, DIVISOR = 0, 5
THRESHOLD = 0.3


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    return np.log((pos + SMOOTH) / (n_pos + 2 * SMOOTH)) - np.log((neg + SMOOTH) / (n_neg + 2 * SMOOTH))


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights of the L1-loss support vector machine with a bias (the last weight), one dual variable at a time.

    Rows are scaled to unit length, so that long documents don't outweigh short ones.  Each class's cost is
    in inverse proportion to its rows.
    """
    w = np.zeros(len(scale) + 1)
    values = []
    for x in rows:
        v = scale[x]
        values.append(np.append(v, 1.0) / np.sqrt((v * v).sum() + 1.0))
    index = [np.append(x, len(scale)) for x in rows]
    most = np.where(signs > 0, COST * len(signs) / (2 * max(1, (signs > 0).sum())), COST * len(signs) / (2 * max(1, (signs < 0).sum())))
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i, v = index[k], values[k]
            gradient = signs[k] * (w[i] @ v) - 1.0  # rows have unit length: the diagonal of the dual is 1
            new = min(max(alpha[k] - gradient, 0.0), most[k])
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * signs[k] * v
                alpha[k] = new
    return w


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * b)
        b += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


class Model:
    """A linear model over hashed features; without both classes to learn from, the share of label 1 (0.5 where none is)."""

    def __init__(self, weights: np.ndarray | None, scale: np.ndarray | None, slope: float, offset: float, share: float):
        self.weights, self.scale, self.slope, self.offset, self.share = weights, scale, slope, offset, share

    def margin(self, x: np.ndarray) -> float:
        v = self.scale[x]
        return (float(self.weights[x] @ v) + float(self.weights[-1])) / float(np.sqrt((v * v).sum() + 1.0))

    def score(self, x: np.ndarray) -> float:
        if self.weights is None:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows whose crc32 of doc_id modulo ``DIVISOR`` is not ``HELD_OUT``."""
    features = stored(featured(labelled(docs, labels, "quality", DIVISOR, HELD_OUT), stylistic), "quality-features")
    sizes = {int(r["y"] == 1): r["count"] for r in features.groupBy((F.col("y") == 1).alias("y")).count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model(None, None, 0.0, 0.0, 0.5 if not n_pos + n_neg else n_pos / (n_pos + n_neg))
    counts = class_counts(features, LEAST_ROWS)
    scale = np.zeros(BUCKETS)
    scale[counts["bucket"]] = log_ratios(counts["pos"].to_numpy(), counts["neg"].to_numpy(), n_pos, n_neg)
    rows = sample(features, n_pos + n_neg, SAMPLE)
    y = np.array([int(label == 1) for label, _ in rows])
    fitted = np.arange(len(rows)) % 4 != 3
    if len(set(y[fitted])) < 2 or len(set(y[~fitted])) < 2:
        fitted[:] = True
    weights = dual_coordinate_descent([x for (_, x), f in zip(rows, fitted, strict=True) if f], np.where(y[fitted] == 1, 1.0, -1.0), scale)
    model = Model(weights, scale, 1.0, 0.0, n_pos / (n_pos + n_neg))
    rest = ~fitted if not fitted.all() else fitted
    model.slope, model.offset = calibrate(np.array([model.margin(x) for (_, x), f in zip(rows, rest, strict=True) if f]), y[rest])
    return model


def with_score(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """``docs`` with the probability that quality is 1 in a new column; null text counts as empty, empty texts are scored too."""
    kept = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # bounded by BUCKETS
    return docs.withColumn(column, scored(F.coalesce(F.col("text").cast("string"), F.lit("")), lambda t: kept.value.score(stylistic(t))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    A null doc_id is taken as an empty id; rows with null label or id aren't learned from; repeated rows count as often
    as they occur; other columns are never read.  Without labels every score is 0.5.
    """
    rows = with_score(docs.select("doc_id", "text"), labels)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id").cast("long"), DIVISOR) == HELD_OUT).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
