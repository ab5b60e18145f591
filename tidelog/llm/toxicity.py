"""Toxicity by weak supervision (operator 9).

Lexicon voters (words) and pattern voters (word prefixes, and the style of a text) are made from features whose rate in
the two classes differs clearly over all labelled rows that may be learned from.  A generative label model
over the votes, a tree in which each voter depends on the label and on one other voter, is estimated by
expectation-maximisation: it gives the voters' accuracies and their correlations.  Its posterior labels train a
logistic model on the features, which scores texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import id_remainder, stored
from tidelog.llm.features import BUCKETS, STYLES, bucket, class_counts, featured, labelled, lexical, sample, scored

#: Labelled rows that the label model and the classifier are fitted on, at most about; counts are over all of them.
SAMPLE = 16_000
LEAST_ROWS = 4
#: A feature is clear where its log rate ratio exceeds ``CLEAR`` by ``ERRORS`` standard errors.
CLEAR, ERRORS = 2.0, 2.5
WORD_VOTERS, PREFIX_VOTERS = 12, 12
TRUST = 0.99
STEPS, EPOCHS, RATE, SHRINK = 15, 8, 0.5, 1e-5
HELD_OUT, DIVISOR = 1, 3
THRESHOLD = 0.7


def strength(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Lower bound of a feature's log rate ratio between the classes, whichever it speaks for; negative for label 0."""
    a, b = pos + 0.5, neg + 0.5
    ratio = np.log(a / (n_pos + 1)) - np.log(b / (n_neg + 1))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - ERRORS * np.sqrt(1 / a + 1 / b))


def tiers(buckets: np.ndarray, strengths: np.ndarray, n: int) -> list[np.ndarray]:
    """Features dealt to ``n`` voters by strength, the strongest together: so voters differ in accuracy."""
    return np.array_split(buckets[np.argsort(-strengths, kind="stable")], n)


def votes(rows: list[np.ndarray], voter: np.ndarray, n_voters: int) -> np.ndarray:
    """Which voters fire on each row; ``voter`` gives each bucket's voter or -1."""
    out = np.zeros((len(rows), n_voters), np.int8)
    for k, x in enumerate(rows):
        v = voter[x]
        out[k, v[v >= 0]] = 1
    return out


class LabelModel:
    """P(label) and, for each voter, P(vote | label, vote of its parent in the tree), by expectation-maximisation."""

    def __init__(self, v: np.ndarray, known: np.ndarray):
        """``known``: a label of each row, itself one more voter, right in ``TRUST`` of all rows and independent of the others."""
        self.v = v.astype(np.int64)
        told = np.where(known == 1, 1.0, -1.0) * np.log(TRUST / (1 - TRUST))
        q = 1 / (1 + np.exp(-told))
        self.parent = self._tree(q)
        for _ in range(STEPS):
            self._maximise(q)
            q = self.posterior(self.v, told)
        self.labels = q
        self.accuracies = np.array([[q @ (self.v[:, k] == 1) / max(q.sum(), 1e-9), (1 - q) @ (self.v[:, k] == 0) / max((1 - q).sum(), 1e-9)] for k in range(v.shape[1])])

    def _tree(self, q: np.ndarray) -> np.ndarray:
        """Each voter's parent in the tree of greatest mutual information given the label; -1 at its root."""
        n = self.v.shape[1]
        shared = np.zeros((n, n))
        for weight in (q, 1 - q):
            total = weight.sum() + 1e-9
            one = (self.v * weight[:, None]).sum(0) / total
            both = (self.v * weight[:, None]).T @ self.v / total
            for a_on in (0, 1):
                for b_on in (0, 1):
                    pa, pb = (one if a_on else 1 - one)[:, None], (one if b_on else 1 - one)[None, :]
                    p = both if a_on and b_on else one[:, None] - both if a_on else one[None, :] - both if b_on else 1 - one[:, None] - one[None, :] + both
                    p = np.clip(p, 1e-12, 1)
                    shared += total * p * np.log(p / np.clip(pa * pb, 1e-12, 1))
        self.correlation = shared / len(self.v)
        parent, best, seen = np.full(n, -1), shared[0].copy(), np.zeros(n, bool)
        seen[0], origin = True, np.zeros(n, int)
        for _ in range(n - 1):
            k = int(np.argmax(np.where(seen, -np.inf, best)))
            parent[k], seen[k] = origin[k], True
            closer = shared[k] > best
            best[closer], origin[closer] = shared[k][closer], k
        return parent

    def _maximise(self, q: np.ndarray):
        self.prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        self.p = np.zeros((self.v.shape[1], 2, 2))  # voter, label, vote of the parent
        for k, up in enumerate(self.parent):
            above = self.v[:, up] if up >= 0 else np.zeros(len(self.v), np.int64)
            for label, weight in ((1, q), (0, 1 - q)):
                rate = (weight @ self.v[:, k] + 0.1) / (weight.sum() + 1.0)
                for u in (0, 1):
                    w = weight * (above == u)
                    self.p[k, label, u] = np.clip((w @ self.v[:, k] + rate) / (w.sum() + 1.0), 1e-5, 1 - 1e-5)

    def posterior(self, v: np.ndarray, told: np.ndarray | float = 0.0) -> np.ndarray:
        odds = told + np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k, up in enumerate(self.parent):
            above = v[:, up] if up >= 0 else np.zeros(len(v), np.int64)
            one, zero = self.p[k, 1][above], self.p[k, 0][above]
            odds += np.where(v[:, k] == 1, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(rows: list[np.ndarray], target: np.ndarray, seed: int = 9) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on indicators with soft targets, by adaptive gradient steps."""
    w, g, bias, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), 1.0
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            x = rows[k]
            e = target[k] - 1 / (1 + np.exp(-min(max(w[x].sum() + bias, -30), 30)))
            d = e - SHRINK * w[x]
            g[x] += d * d
            w[x] += RATE * d / np.sqrt(g[x])
            gb += e * e
            bias += 0.1 * e / np.sqrt(gb)
    return w, bias


class Model:
    """Logistic model over clear features; without both classes to learn from, the share of label 1 (0.5 where none is)."""

    def __init__(self, weights: np.ndarray | None, bias: float, share: float):
        self.weights, self.bias, self.share = weights, bias, share

    def score(self, x: np.ndarray) -> float:
        if self.weights is None:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.weights[x].sum() + self.bias, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows whose crc32 of doc_id modulo ``DIVISOR`` is not ``HELD_OUT``."""
    features = stored(featured(labelled(docs, labels, "toxic", DIVISOR, HELD_OUT), lexical), "toxicity-features")
    sizes = {int(r["y"] == 1): r["count"] for r in features.groupBy((F.col("y") == 1).alias("y")).count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    share = 0.5 if not n_pos + n_neg else n_pos / (n_pos + n_neg)
    if not n_pos or not n_neg:
        return Model(None, 0.0, share)
    counts = class_counts(features, LEAST_ROWS)
    buckets, z = counts["bucket"].to_numpy(), strength(counts["pos"].to_numpy(), counts["neg"].to_numpy(), n_pos, n_neg)
    used = np.zeros(BUCKETS, bool)
    used[buckets[np.abs(z) >= CLEAR]] = True
    voter = np.full(BUCKETS, -1)
    for first, n, own in ((0, WORD_VOTERS, buckets < BUCKETS // 2), (WORD_VOTERS, PREFIX_VOTERS, buckets >= BUCKETS // 2)):
        own &= z >= CLEAR
        for k, tier in enumerate(tiers(buckets[own], z[own], n)):
            voter[tier] = first + k
    for k, name in enumerate(STYLES):
        voter[bucket("style", name)] = WORD_VOTERS + PREFIX_VOTERS + k
    rows = sample(features, n_pos + n_neg, SAMPLE)
    v = votes([x for _, x in rows], voter, WORD_VOTERS + PREFIX_VOTERS + len(STYLES))
    y = np.array([int(label == 1) for label, _ in rows], float)
    weights, bias = logistic([x[used[x]] for _, x in rows], LabelModel(v, y).labels)
    return Model(weights, bias, share)


def with_score(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """``docs`` with the probability that toxic is 1 in a new column; null text counts as empty, empty texts are scored too."""
    kept = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # bounded by BUCKETS
    return docs.withColumn(column, scored(F.coalesce(F.col("text").cast("string"), F.lit("")), lambda t: kept.value.score(lexical(t))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    A null doc_id is taken as an empty id; rows with null label or id aren't learned from; repeated rows count as often
    as they occur; other columns are never read.  Without labels every score is 0.5.
    """
    rows = with_score(docs.select("doc_id", "text"), labels)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id").cast("long"), DIVISOR) == HELD_OUT).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
