"""Subword lattice likelihood of documents (operator 1).

A text is a sequence of words and an end.  The pieces of an existing public vocabulary span the lattice of a word; their
scores start from the order of that vocabulary and are estimated from the distinct words of the training rows by
expectation-maximisation over all segmentations.  A word that training rows hold has one more arc, the whole word, with its
discounted relative count; the discounts go to the lattice of pieces.  The forward recursion in log space gives the
marginal probability of each word, and their sum that of the document:

    P(word) = max(c - d, 0) / N + d * V / N * (sum over segmentations of the product of piece scores)

Words are counted in chunks of documents before any shuffle, each distinct word's lattice is run once, and the scores
go back to the chunks that hold the word.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import id_remainder, stored, texts
from tidelog.llm.lattice import MARK, Lattice

DIVISOR, HELD_OUT = 10, 0
#: Documents in a chunk, about; words whose lattices are run together; most frequent words that every task holds.
CHUNK = 4000
TOGETHER = 50_000
FREQUENT = 200_000
ROUNDS = 2
SMOOTH = 0.01
ADD = 0.1
#: The end of a text among the words; no word is empty.
END = ""


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space only


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file that can lie in a word, and their first scores, by their order in the file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    order = {}
    for k in range(p.get_piece_size()):
        piece = p.id_to_piece(k)
        if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k)) and piece.rfind(MARK) <= 0:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in piece)
            order[low] = max(order.get(low, -math.inf), p.get_score(k))  # scores of such files fall with the rank
    order.setdefault(MARK, min(order.values()) - 1)
    pieces = sorted(order, key=lambda x: (-order[x], x))
    start = 1.0 / (10 + np.arange(len(pieces) + 2))
    return pieces, np.log(start / start.sum())


def _chunks(docs: DataFrame, n: int) -> DataFrame:
    rows = texts(docs).withColumn("held_out", id_remainder(F.col("doc_id"), DIVISOR) == HELD_OUT)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, "chunk")


def _chunk_words(batches):
    """chunk, word, trained: the distinct words of each chunk and their count in its training rows."""
    chunks: dict[int, tuple[Counter, set]] = {}
    for pdf in batches:
        for chunk, held, text in zip(pdf["chunk"], pdf["held_out"], pdf["text"], strict=True):
            counts, others = chunks.setdefault(chunk, (Counter(), set()))
            (others if held else counts).update(words_of(text))
            if not held:
                counts[b""] += 1
            else:
                others.add(b"")
    while chunks:
        chunk, (counts, others) = chunks.popitem()
        for w in others:
            counts.setdefault(w, 0)
        words = list(counts)
        for k in range(0, len(words), 50_000):
            part = words[k:k + 50_000]
            yield pd.DataFrame({"chunk": chunk, "word": [w.decode("utf-8", "replace") for w in part], "trained": [counts[w] for w in part]})


def _together(batches):
    """Batches joined to ``TOGETHER`` rows or more, so that many words have one length."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= TOGETHER:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def estimate(types: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Pieces and their scores after ``rounds`` of expectation-maximisation over the distinct words, each counted once.

    Each task adds up its words' expected uses; a row for each piece comes to the driver.
    """
    pieces, scores = vocabulary(path)
    for _ in range(rounds):
        now = types.sparkSession.sparkContext.broadcast(scores)  # bounded by the vocabulary

        def uses(batches, now=now):
            lattice, total = Lattice(pieces), None
            for pdf in _together(batches):
                x = lattice.expected(list(pdf["word"]), np.ones(len(pdf)), now.value)
                total = x if total is None else total + x
            if total is not None:
                yield pd.DataFrame({"piece": np.nonzero(total)[0], "uses": total[np.nonzero(total)[0]]})

        got = types.mapInPandas(uses, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        count = np.full(len(pieces) + 2, SMOOTH)
        count[got["piece"]] += got["uses"]
        scores = np.log(count / count.sum())
    return pieces, scores


def score_words(types: DataFrame, pieces: list[str], scores: np.ndarray, n: int, v: int, discount: float) -> DataFrame:
    """word, c, score (log10 of its probability) of every distinct word."""
    kept = types.sparkSession.sparkContext.broadcast((pieces, scores))  # bounded by the vocabulary

    def run(batches):
        pieces, scores = kept.value
        lattice = Lattice(pieces)
        begins = np.array([p.startswith(MARK) for p in pieces])
        start = np.exp(scores[:-2][begins]).sum() + np.exp(scores[-1])
        for pdf in _together(batches):
            c = pdf["c"].to_numpy().astype(float)
            words = list(pdf["word"])
            spelt = np.full(len(words), scores[-1] - np.log(start))  # the end, where a word or the end may come
            some = np.nonzero([w != END for w in words])[0]
            spelt[some] = lattice.log_marginals([words[k] for k in some], scores)
            if n:
                with np.errstate(divide="ignore"):
                    spelt = np.logaddexp(np.log(np.maximum(c - discount, 0) / n), np.log(discount * v / n) + spelt)
            yield pd.DataFrame({"word": words, "c": pdf["c"], "score": spelt / math.log(10)})

    return types.mapInPandas(run, "word string, c long, score double")


def likelihoods(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    Null or empty text: the end alone.  A null doc_id is taken as an empty id.  Repeated rows count as often as they occur.
    Without training rows the pieces keep their first scores.  Other columns are not read; an empty table gives no rows.
    """
    chunks = max(1, -(-docs.count() // CHUNK))
    dealt = _chunks(docs, chunks)
    held = stored(dealt.select("chunk", "held_out", "text").mapInPandas(_chunk_words, "chunk long, word string, trained long"), "chunk-words")
    types = stored(held.groupBy("word").agg(F.sum("trained").alias("c")), "words")
    known = F.col("c") > 0
    n, v, once, twice = types.agg(F.sum("c"), F.sum(known.cast("long")), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    n, v, once, twice = n or 0, v or 0, once or 0, twice or 0
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    pieces, scores = estimate(types.filter(known & (F.col("word") != END)).select("word"), vocab_path)
    weighed = stored(score_words(types, pieces, scores, n, v, discount), "word-scores")
    # The most frequent words, whose number is bounded, go to every task; the others go back to the chunks that hold them.
    often = types.groupBy("c").count().orderBy(F.desc("c")).limit(FREQUENT).toPandas()
    least = int(often["c"][often["count"].cumsum() <= FREQUENT].min()) if len(often) and often["count"][0] <= FREQUENT else n + 1
    top = weighed.filter(F.col("c") >= max(1, least)).toPandas()
    frequent = docs.sparkSession.sparkContext.broadcast({w.encode(): (c, x) for w, c, x in zip(top["word"], top["c"], top["score"], strict=True)})
    rare = weighed.filter(F.col("c") < max(1, least)).withColumn("key", F.xxhash64("word"))
    by_chunk = held.select("chunk", F.xxhash64("word").alias("key")).join(rare.select("key", "word", "c", "score"), "key").drop("key")

    def run(key, rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        found = {w.encode(): (c, x) for w, c, x in zip(words["word"], words["c"], words["score"], strict=True)}
        common = frequent.value
        bases, out = {}, []
        for doc, out_of, text in zip(rows["doc_id"].astype("Int64"), rows["held_out"], rows["text"], strict=True):
            pairs = [common.get(x) or found.get(x) or found[x.decode("utf-8", "replace").encode()] for x in [*words_of(text), b""]]
            counts = Counter([c for c, _ in pairs])
            for c in counts:
                if c not in bases:
                    bases[c] = math.log10((c + ADD) / (n + ADD * (v + 1)))
            out.append((doc, out_of, len(pairs), len(pairs) - counts[0], n, math.fsum([bases[c] * k for c, k in counts.items()]), math.fsum([x for _, x in pairs])))
        got = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return got.assign(doc_id=got["doc_id"].astype("Int64"))

    return dealt.groupBy("chunk").cogroup(by_chunk.groupBy("chunk")).applyInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
