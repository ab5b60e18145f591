"""Hashed indicator features of texts, and counts of them by class over all labelled rows.

Every distinct word is hashed once per worker and kept for as long as the worker stays with the operator; the kept words are
bounded by ``KEPT``.
"""

from __future__ import annotations

import functools
import string
import zlib
from collections.abc import Callable
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import id_remainder, texts, word_cache

#: Features are hashed into this many buckets: it bounds the models, whatever the corpus.
BUCKETS = 1 << 18
KEPT = 400_000
#: Shares of words that repeat the word before them, each an indicator.
REPEATS = (0.0, 0.02, 0.1, 0.3, 0.6)
PREFIXES = (4, 5, 6)


def bucket(kind: str, what: str) -> int:
    """Words share the lower half of the buckets, features of other kinds the upper half."""
    half = BUCKETS // 2
    return zlib.crc32(f"{kind}:{what}".encode("utf-8", "replace")) % half + half * (kind != "w")


def bare(word: str) -> str:
    """A word in lower case without the punctuation around it."""
    return word.strip(string.punctuation).lower()


def _word_and_prefixes(word: str) -> bytes:
    """Buckets (int32) of a word and its prefixes."""
    w = bare(word)
    if not w:
        return b""
    return np.array([bucket("w", w), *(bucket(f"p{n}", w[:n]) for n in PREFIXES if len(w) > n)], np.int32).tobytes()


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as A, a and 0; other characters as they are, runs of one shortened to two."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k or (k not in "Aa0" and out[-2:] != [k, k]):
            out.append(k)
    return "".join(out)


def style(text: str) -> list[str]:
    """Patterns of a text as a whole: shouting, many exclamation marks, very short."""
    n = max(1, len(text))
    held = (("shouts", sum(map(str.isupper, text)) > 0.3 * n), ("exclaims", text.count("!") > 0.01 * n), ("short", n < 60))
    return [name for name, holds in held if holds]


STYLES = ("shouts", "exclaims", "short")


def lexical(text: str) -> np.ndarray:
    """Distinct buckets of a text's words, their prefixes and the patterns of its style."""
    kept = word_cache("prefixes")
    found = [np.array([bucket("style", x) for x in style(text)], np.int32).tobytes()]
    for w in set(text.split()):
        x = kept.get(w)
        if x is None:
            x = _word_and_prefixes(w)
            if len(kept) < KEPT:
                kept[w] = x
        found.append(x)
    return np.unique(np.frombuffer(b"".join(found), np.int32))


@functools.lru_cache(1 << 16)
def _pair(a: int, b: int) -> int:
    return bucket("s2", f"{a} {b}")


def stylistic(text: str) -> np.ndarray:
    """Distinct buckets of word 1-grams, word-shape 1- and 2-grams, and shares of repeated word 2-grams."""
    words = text.split()
    kept = word_cache("shapes")
    seen, shapes = set(), []
    for w in words:
        x = kept.get(w)
        if x is None:
            x = (bucket("w", bare(w)), bucket("s1", shape(w)))
            if len(kept) < KEPT:
                kept[w] = x
        seen.add(x[0])
        shapes.append(x[1])
    seen.update(shapes)
    seen.update([_pair(a, b) for a, b in set(zip(shapes, shapes[1:], strict=False))])
    share = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    seen.update([bucket("r", str(k)) for k, least in enumerate(REPEATS) if share > least])
    seen.add(bucket("n", str(min(len(words), 8))))
    return np.fromiter(seen, np.int32, len(seen))


def labelled(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """doc_id, text, y of the labelled rows that may be learned from; rows with null id or label are not."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    train = id_remainder(F.col("doc_id"), divisor)
    wanted = (train != 0) if held_out == 0 else (train != held_out)
    # Labels grow with the documents: the join is by shuffle at every size.
    return texts(docs).filter(wanted).join(known.filter(wanted).hint("merge"), "doc_id")


def featured(rows: DataFrame, featurise: Callable[[str], np.ndarray]) -> DataFrame:
    """doc_id, y, features (binary: int32 buckets)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "features": [featurise(t).astype(np.int32).tobytes() for t in pdf["text"]]})

    return rows.mapInPandas(run, "doc_id long, y int, features binary")


def class_counts(features: DataFrame, least: int) -> pd.DataFrame:
    """bucket, pos, neg: labelled rows of either class with the feature, over all rows; buckets of ``least`` rows or more.

    Each task sums its rows before the shuffle; at most BUCKETS rows come to the driver.
    """

    def run(batches):
        pos, neg = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for y, x in zip(pdf["y"], pdf["features"], strict=True):
                (pos if y == 1 else neg)[np.frombuffer(x, np.int32)] += 1
        seen = np.nonzero(pos + neg)[0]
        yield pd.DataFrame({"bucket": seen, "pos": pos[seen], "neg": neg[seen]})

    counts = features.select("y", "features").mapInPandas(run, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return counts.filter(F.col("pos") + F.col("neg") >= least).toPandas().sort_values("bucket").reset_index(drop=True)


def sample(features: DataFrame, total: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(y, features) of at most about ``most`` rows, chosen by a hash of doc_id, in its order."""
    parts = 1 << 20
    chosen = features.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(parts)) < (parts if total <= most else parts * most // total))
    rows = chosen.select("y", "features", F.xxhash64("doc_id").alias("h"), "doc_id").toPandas().sort_values(["h", "doc_id"])
    return [(int(y), np.frombuffer(x, np.int32)) for y, x in zip(rows["y"], rows["features"], strict=True)]


def scored(text: Column, score: Callable[[str], float]) -> Column:
    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([score(t) for t in batch], dtype="float64")

    return run(text)
