"""Exact deduplication against a minimal perfect hash of historical digests (operator 4).

The distinct digests of the history are dealt into shards by their first bytes.  Each shard gets a minimal
perfect hash (hash and displace): a slot for each digest, which holds the full digest and the winner's locator
(its doc_id).  New digests look up their slot and count as members only if the slot's full digest is theirs;
nonmembers are grouped among themselves.  Every row of a group is then compared byte for byte with the text of
its winner; rows that differ (a digest collision) are grouped by their text itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import SPACES, stored, texts

#: Digests in a shard at most, about: a shard's table is built and probed by one task.
SHARD = 2_000
#: Digests that share a displacement, on average.
SHARE = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def _buckets(digests: np.ndarray, n: int) -> np.ndarray:
    return (digests[:, 1] % np.uint64(n)).astype(np.int64)


def _slots(digests: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """Slot of each digest under its bucket's displacement."""
    with np.errstate(over="ignore"):
        x = digests[:, 2] + displace.astype(np.uint64) * (digests[:, 3] | np.uint64(1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(n)).astype(np.int64)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4).astype(np.uint64)


def build(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each digest): a minimal perfect hash of distinct 32-byte digests.

    Buckets go in falling size, each to the first displacement that puts all its digests into free slots;
    a bucket of one digest takes a free slot outright, written as the displacement -1 - slot.
    """
    n = len(digests)
    words = _words(digests)
    n_buckets = max(1, n // SHARE)
    bucket = _buckets(words, n_buckets)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    displace, slot, taken = np.zeros(n_buckets, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    free, at = None, 0
    for b in np.argsort(starts[:-1] - starts[1:], kind="stable"):
        own = order[starts[b]:starts[b + 1]]
        if len(own) == 0:
            break
        if len(own) == 1:
            if free is None:
                free = np.nonzero(~taken)[0]
            s = free[at:at + 1]
            at += 1
            displace[b] = -1 - s[0]
        else:
            first = 0
            while True:
                tries = np.arange(first, first + 16)
                s = _slots(np.repeat(words[own], 16, axis=0), np.tile(tries, len(own)), n).reshape(len(own), 16)
                apart = np.sort(s, axis=0)
                good = np.nonzero(~taken[s].any(0) & (apart[1:] != apart[:-1]).all(0))[0]
                if len(good):
                    displace[b], s = tries[good[0]], s[:, good[0]]
                    break
                first += 16
        taken[s] = True
        slot[own] = s
    return displace, slot


def look_up(digests: list[bytes], displace: np.ndarray, n: int) -> np.ndarray:
    """The only slot that may hold each digest."""
    words = _words(digests)
    d = displace[_buckets(words, len(displace))]
    return np.where(d < 0, -1 - d, _slots(words, np.maximum(d, 0), n))


def perfect_hash(history: DataFrame, shards: int) -> DataFrame:
    """history (digest, keep_id, rows), distinct by digest -> a row for each shard: shard, displace, digests, keep_ids, rows by slot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = list(pdf["digest"])
        displace, slot = build(digests)
        by_slot = np.argsort(slot)
        keep = pdf["keep_id"].astype("Int64")
        return pd.DataFrame([{"shard": pdf["shard"].iat[0], "displace": displace.tolist(), "digests": [digests[k] for k in by_slot],
                              "keep_ids": [None if x is pd.NA else int(x) for x in keep.iloc[by_slot]], "rows": pdf["rows"].to_numpy()[by_slot].tolist()}])

    return history.withColumn("shard", _shard(F.col("digest"), shards)).groupBy("shard").applyInPandas(
        run, "shard long, displace array<long>, digests array<binary>, keep_ids array<long>, rows array<long>")


def _shard(digest: Column, shards: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long") % shards


def probe(new: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """new (digest, keep_id, rows), distinct by digest -> those columns with member, old_keep_id, old_rows by a checked look-up."""
    schema = "digest binary, keep_id long, rows long, member boolean, old_keep_id long, old_rows long"

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.assign(member=False, old_keep_id=pd.array([None] * len(left), "Int64"), old_rows=0)
        left["keep_id"] = left["keep_id"].astype("Int64")
        if len(left) and len(right):
            row = right.iloc[0]
            slots = look_up(list(left["digest"]), np.asarray(row["displace"], np.int64), len(row["digests"]))
            left["member"] = [bytes(row["digests"][s]) == bytes(d) for s, d in zip(slots, left["digest"], strict=True)]
            keep = [row["keep_ids"][s] if m else None for s, m in zip(slots, left["member"], strict=True)]
            left["old_keep_id"] = pd.array([None if x is None or x != x else int(x) for x in keep], "Int64")
            left["old_rows"] = [int(row["rows"][s]) if m else 0 for s, m in zip(slots, left["member"], strict=True)]
        return left[["digest", "keep_id", "rows", "member", "old_keep_id", "old_rows"]]

    left = new.withColumn("shard", _shard(F.col("digest"), shards))
    return left.groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(run, schema)


def by_digest(rows: DataFrame) -> DataFrame:
    """Rows of equal digest counted before they are shuffled: a group of any size is one row for each task."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))


def deduplicate(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, member: one row for each row of ``docs``.

    ``historical`` (a condition on doc_id) names the rows whose distinct digests make the perfect hash; the others look
    theirs up in it.  None: the lower half of the range of doc_id.  Texts are equal when identical after each run of
    ASCII white space is replaced by one blank; null text is empty.  keep_id is the smallest doc_id of the group (null ids
    count only where a group has no other); kept holds where doc_id is keep_id, so rows that repeat a kept doc_id are kept
    with it.  Empty table: no rows.  Extra columns are not read.
    """
    rows = texts(docs).withColumn("text", normalised(F.col("text")))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    narrow = stored(rows.select("doc_id", "digest"), "digests")
    if historical is None:
        ends = narrow.agg(F.min("doc_id"), F.max("doc_id")).first()
        middle = 0 if ends[0] is None else (ends[0] + ends[1]) // 2
        historical = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    history = by_digest(narrow.filter(historical))
    new = by_digest(narrow.filter(~historical))
    shards = max(1, -(-narrow.count() // SHARD))
    found = probe(new, perfect_hash(history, shards), shards)
    # Members join the historical group; nonmembers are groups of their own.
    groups = history.select("digest", "keep_id", "rows", F.lit(True).alias("member")).unionByName(
        found.select("digest", F.when(F.col("member"), F.least("keep_id", "old_keep_id")).otherwise(F.col("keep_id")).alias("keep_id"), "rows", "member"))
    groups = groups.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("rows").alias("group_size"), F.max("member").alias("member"))
    groups = stored(groups, "digest-groups")
    repeated = groups.filter("group_size > 1").select("digest", "keep_id")
    # Byte check.  What is stored in between lets Spark split a digest with very many rows in the joins.
    again = stored(rows.join(repeated.hint("merge"), "digest"), "repeated-texts")
    winners = stored(again.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("winner_text")), "winner-texts")
    checked = stored(again.join(winners, "digest").filter(F.col("text") != F.col("winner_text")).select("doc_id", "digest", "text"), "digest-collisions")
    decided = narrow.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                                                   F.lower(F.hex("digest")).alias("text_sha256"), "member")
    if not checked.isEmpty():
        decided = _regrouped(rows, narrow, groups, checked, decided)
    return decided


def _regrouped(rows: DataFrame, narrow: DataFrame, groups: DataFrame, collided: DataFrame, decided: DataFrame) -> DataFrame:
    """Groups of collided digests formed anew by digest and text."""
    odd = collided.select("digest").distinct()
    rest = narrow.join(odd, "digest", "left_anti").join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member")
    own = rows.join(odd, "digest")
    by_text = own.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    anew = own.join(by_text, ["digest", "text"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.lit(False).alias("member"))
    return rest.unionByName(anew.select(*rest.columns))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest doc_id.  All columns stay."""
    key = {"_tl_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_tl_sha": F.sha2(normalised(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256)}
    kept = deduplicate(docs).filter("kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_tl_id"), F.col("text_sha256").alias("_tl_sha"))
    rows = docs.withColumns(key).join(kept.hint("merge"), list(key), "left_semi")
    return rows.dropDuplicates(list(key)).drop(*key)  # rows that repeat a kept one, id and text
