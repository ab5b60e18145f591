"""Ranked lexical search (operator 12): exact top documents for each item by norm-bucketed inner products.

A document is a vector of impacts over the items' terms, an item a vector of term weights; the score is their inner product.
Documents are ordered by the length of their weighted vectors and cut into buckets of similar length.  A bucket can't help an
item where Cauchy-Schwarz bounds its scores below the item's tenth best; inside a bucket the greatest impact of each
coordinate bounds what the light terms can add, so that only documents with a heavy term survive.  Survivors are scored in
64-bit integers.  The longest vectors are searched first for thresholds, then every bucket runs in parallel.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import stored

#: Documents, and terms of documents, that one bucket holds at most.
BUCKET_DOCS, BUCKET_TERMS = 4096, 1 << 21
#: Longest vectors that are searched first for thresholds.
SEEDS = 4096
#: Bytes of item texts that are searched for in one pass over the documents; more items take more passes.
PASS_BYTES = 32 << 20
#: Fixed values of the score.
WEIGHT, IMPACT, SATURATION, BLEND, FLAT = 1000, 1_000_000_000, 8, 90, 10

#: A-Z to lower case; every ASCII character that isn't a letter or digit to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Float bounds are raised by this share, beyond what rounding can take from them.
SLACK = 1 + 1e-9

VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def utf8(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def count_terms(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the numbered terms of each document that has any term, ascending, with their counts."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = terms_of(text.as_py())
                if words:
                    own = sorted((number[t], k) for t, k in Counter(words).items() if t in number)
                    out.append((doc, len(words), np.array([t for t, _ in own], "<i4").tobytes(), np.array([k for _, k in own], "<i8").tobytes()))
            columns = list(zip(*out)) or [()] * len(VECTORS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, VECTORS, strict=True)], schema=VECTORS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each numbered term: counted in the tasks, then added up; as many numbers as the pass has terms."""

    def run(batches):
        count = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                count[np.frombuffer(terms.as_buffer(), "<i4")] += 1
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Statistics:
    """Counts over all documents, the terms' weights, and the impacts that follow from them."""

    def __init__(self, n_docs: int, n_words: int, df: np.ndarray):
        self.n_docs, self.n_words = n_docs, n_words
        self.weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def impacts(self, n: int, tfs: np.ndarray) -> np.ndarray:
        m = FLAT + BLEND * n * self.n_docs // self.n_words
        return IMPACT * tfs // (1000 * tfs + SATURATION * m)


def with_length(vectors: DataFrame, stats: Statistics) -> DataFrame:
    """``vectors`` with the length of each weighted impact vector; those without a weighted term can't be found and go."""
    schema = VECTORS.append(pa.field("length", pa.float64()))

    def run(batches):
        for batch in batches:
            lengths = []
            for n, terms, tfs in zip(batch["n"].to_pylist(), batch["terms"], batch["tfs"], strict=True):
                weighted = stats.weight[np.frombuffer(terms.as_buffer(), "<i4")] * stats.impacts(n, np.frombuffer(tfs.as_buffer(), "<i8")).astype(np.float64)
                lengths.append(math.sqrt(float(weighted @ weighted)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.float64())], schema=schema)

    return vectors.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary, length double").filter("length > 0")


class Bucket:
    """Documents of similar length as posting lists by term, with each term's greatest impact."""

    def __init__(self, rows: list[tuple], stats: Statistics):
        self.null = np.array([r[0] is None for r in rows])
        self.docs = np.array([r[0] or 0 for r in rows], np.int64)
        self.length = max(r[4] for r in rows)
        terms = np.concatenate([r[2] for r in rows])
        impacts = np.concatenate([stats.impacts(r[1], r[3]) for r in rows])
        order = np.argsort(terms, kind="stable")
        self.at = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])[order]
        self.impacts = impacts[order]
        self.terms, self.begin = np.unique(terms[order], return_index=True)
        self.end = np.append(self.begin[1:], len(terms))
        self.greatest = np.maximum.reduceat(self.impacts, self.begin)

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the documents that score ``least`` or more, and maybe of others."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if math.sqrt(len(terms)) * self.length * SLACK < least:  # the item is 1 in each of its terms, weights are the document's
            return none
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weights > 0)
        at, weights = at[here], weights[here]
        bound = weights * self.greatest[at]
        order = np.argsort(bound, kind="stable")
        at, weights, together = at[order], weights[order], np.cumsum(bound[order])
        light = int(np.searchsorted(together, least, "left"))  # even all together, the first ones stay below
        if light == len(at):
            return none
        lists = [(self.at[self.begin[k]:self.end[k]], self.impacts[self.begin[k]:self.end[k]]) for k in at.tolist()]
        rows = np.unique(np.concatenate([r for r, _ in lists[light:]]))
        scores = np.zeros(len(rows), np.int64)
        for (docs, impacts), w in zip(lists, weights.tolist(), strict=True):
            k = np.searchsorted(docs, rows)
            hit = np.flatnonzero(docs[np.minimum(k, len(docs) - 1)] == rows)
            scores[hit] += w * impacts[k[hit]]
        return rows, scores


def best(score: np.ndarray, null: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Numbers of the best: high score, then small doc_id, null doc_id last."""
    if len(score) > 4 * top:
        keep = np.flatnonzero(score >= np.partition(score, -top)[-top])
        return keep[np.lexsort((doc[keep], null[keep], -score[keep]))[:top]]
    return np.lexsort((doc, null, -score))[:top]


def search(vectors: DataFrame, stats: Statistics, items: list[np.ndarray], least: list[int], top: int) -> DataFrame:
    """(item, doc_id, score): of each task's buckets, the best documents that score ``least`` of their item or more."""
    weights = [stats.weight[t] for t in items]
    most = BUCKET_DOCS

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        need = list(least)

        def look(rows):
            bucket = Bucket(rows, stats)
            for k, terms in enumerate(items):
                at, scores = bucket.search(terms, weights[k], need[k])
                good = np.flatnonzero(scores >= max(need[k], 1))
                if not len(good):
                    continue
                score, null, doc = (np.concatenate(c) for c in zip(found[k], (scores[good], bucket.null[at[good]], bucket.docs[at[good]])))
                keep = best(score, null, doc, top)
                found[k] = score[keep], null[keep], doc[keep]
                if len(keep) == top:
                    need[k] = max(need[k], int(found[k][0][-1]))

        rows, held = [], 0
        for batch in batches:
            for doc, n, terms, tfs, length in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "terms", "tfs", "length")), strict=True):
                rows.append((doc, n, np.frombuffer(terms, "<i4"), np.frombuffer(tfs, "<i8"), length))
                held += len(terms) // 4
                if len(rows) >= most or held >= BUCKET_TERMS:
                    look(rows)
                    rows, held = [], 0
        if rows:
            look(rows)
        out = [(k, None if null else doc, score) for k, f in enumerate(found) for score, null, doc in zip(*(c.tolist() for c in f))]
        columns = list(zip(*out)) or [()] * len(FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    return vectors.select("doc_id", "n", "terms", "tfs", "length").mapInArrow(run, "item int, doc_id long, score long")


def item_passes(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) of the items, as many at once as their bytes allow; the driver holds one such block."""
    block, held = [], 0
    for r in items.select("item_id", utf8("text").alias("text")).toLocalIterator():
        block.append((r["item_id"], bytes(r["text"])))
        held += len(r["text"])
        if held >= PASS_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` documents of highest score above 0 for each row of ``items``: item_id, rank, doc_id, score.

    Equal scores by ascending doc_id, null doc_id last.  Null text has no terms: such a document is never found and not
    counted, such an item gives no rows, like an item whose terms no document holds.  Repeated rows are documents, or items, of
    their own (rows of one item_id then repeat its ranks).  Empty tables give no rows; other columns are not read.  Texts of
    any length are counted whole.
    """
    spark = docs.sparkSession
    item_type = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for block in item_passes(items):
        own = [list(dict.fromkeys(terms_of(text))) for _, text in block]
        number = {t: k for k, t in enumerate(dict.fromkeys(t for terms in own for t in terms))}
        wanted = [np.array(sorted(number[t] for t in terms), np.int64) for terms in own]
        vectors = stored(count_terms(docs, number), "lexical-counts")
        total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).collect()[0]
        if not total["docs"] or not number:
            continue
        stats = Statistics(total["docs"], total["words"], document_frequencies(vectors, len(number)))
        vectors = with_length(vectors, stats)
        # Ties in length are split by doc_id, so that many alike documents don't fall to one task.
        by_length = stored(vectors.repartitionByRange(F.col("length").desc(), "doc_id", F.xxhash64("terms", "tfs"))
                           .sortWithinPartitions(F.col("length").desc()), "lexical-vectors")
        longest = by_length.orderBy(F.col("length").desc(), "doc_id").limit(SEEDS)
        least = [0] * len(wanted)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        for r in search(longest, stats, wanted, least, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == top).collect():
            least[r["item"]] = r["score"]
        ranked = (search(by_length, stats, wanted, least, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {item_type}")
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
