"""I-Match document fingerprints (operator 7), in DataFrame operations only.

The document frequency of every term (by its 64-bit hash) is counted over all documents.  Terms whose inverse document
frequency lies in the chosen band make the lexicon, a table that is joined with the documents' terms.
A text's fingerprint: its distinct lexicon terms, sorted, are hashed once for each of several randomised subsets of
the lexicon.  Subsets keep from all to one in 2048 of the terms, so that long and short texts both
have subsets that an edit leaves alone, and a text with terms has nonzero hashes.  A text without lexicon terms is fingerprinted by all its terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import SPACES, lower_ascii, stored, texts

#: The band: terms of at most one document in 20, in at least two documents.
MOST_SHARE, LEAST_DOCUMENTS = 0.05, 2
#: One term in so many lies in a subset, for each subset; the first has every term, so only a text without terms has none.
THINNED = (1,) + (2,) * 2 + (4,) * 2 + (8,) * 2 + (32,) * 8 + (128,) * 8 + (512,) * 8 + (2048,) * 8
SUBSETS = len(THINNED)
NO_ID = -(1 << 63)
#: A text with at most so many terms below the band's upper bound carries its terms along.
FEW = 16


def terms(text: Column) -> Column:
    """Distinct hashed terms (words in lower case) of a text."""
    words = F.filter(F.split(lower_ascii(text), SPACES), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(rows: DataFrame, most_share: float = MOST_SHARE, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, list[int]]:
    """Table of the terms whose inverse document frequency lies in the band, and the list of those in more documents; counted over all rows.

    The list is short whatever the corpus: at most the mean number of terms in a document, divided by ``most_share``.
    """
    most = max(least, math.floor(most_share * rows.count()))
    counted = rows.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count().filter(F.col("count") >= least)
    counted = stored(counted, "term-documents")
    return counted.filter(F.col("count") <= most).select("term"), [r["term"] for r in counted.filter(F.col("count") > most).select("term").collect()]


def _flagged(pair: Column) -> Column:
    """(text, edited text) -> array of (term, 1 where the first has it + 2 where the second has it)."""
    def marked(kept: Column, flag: int) -> Column:
        return F.transform(kept, lambda t: F.struct(t.alias("term"), F.lit(flag).cast("byte").alias("of")))

    def both(p: Column) -> Column:
        return F.concat(marked(F.array_intersect(p[0], p[1]), 3), marked(F.array_except(p[0], p[1]), 1), marked(F.array_except(p[1], p[0]), 2))

    return F.transform(F.array(F.transform(pair, terms)), both)[0]


def fingerprint(of: Column) -> Column:
    """Sorted array of terms -> array of ``SUBSETS`` ints, 0 where a subset has none of them; null for null."""
    subsets = F.array(*[F.struct(F.lit(7919 * k + 1).alias("seed"), F.lit(THINNED[k]).alias("one_in")) for k in range(SUBSETS)])

    def hashed(own: Column) -> Column:
        def subset(s: Column) -> Column:
            inside = F.filter(own, lambda t: F.pmod(F.xxhash64(t, s["seed"]), s["one_in"]) == 0)
            # An array bound to a lambda's variable is computed once.
            return F.transform(F.array(inside), lambda x: F.when(F.size(x) == 0, 0).otherwise((F.xxhash64(x).bitwiseAND(F.lit(0x7FFFFFFE)) + 1).cast("int")))[0]

        return F.transform(subsets, subset)

    return F.transform(F.array(of), lambda own: F.when(own.isNotNull(), hashed(own)))[0]


def written(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either text; 1 where no subset does, that is where neither text has terms."""
    held = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))
    return F.transform(F.array(held), lambda h: F.when(F.size(h) == 0, 1.0).otherwise(F.size(F.filter(h, lambda p: p["x"] == p["y"])) / F.size(h)))[0]


def successors(rows: DataFrame) -> DataFrame:
    """id, h, n, rank, next_id, next_h, next_rank: each distinct (id, h) and the one after it in ascending order; after the last the first.

    Rows are numbered inside the partitions of a range-partitioned, sorted table; one row for each partition
    gives the numbers before it.
    """
    order = ["id", "h"]
    inside = rows.select("id", "h", "n").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    placed = F.monotonically_increasing_id()
    inside = stored(inside.select("*", F.shiftright(placed, 33).alias("part"), placed.bitwiseAND((1 << 33) - 1).alias("place")), "ordered-ids")
    parts = inside.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    parts = stored(parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before")), "parts")
    total = inside.count()
    ranked = stored(inside.join(F.broadcast(parts), "part").select("id", "h", "n", (F.col("place") + F.col("before")).alias("rank")), "ranked-ids")
    after = ranked.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("rank").alias("next_rank"), F.pmod(F.col("rank") - 1, F.lit(max(1, total))).alias("rank"))
    return ranked.join(after, "rank")


def _with_edited(rows: DataFrame, after: DataFrame, *hints: str) -> DataFrame:
    """id, n, rank, next_rank, pair: the texts of ``after``'s documents and the same, edited."""
    quarter = F.expr("cast(n div 4 as int)")
    # Each document sends the start of its text to the one before it.
    asked = after.select("next_id", "next_h", F.col("id").alias("to_id"), F.col("h").alias("to_h"), "n", "rank", "next_rank")
    for h in hints:
        asked = asked.hint(h)
    # Both joins read the texts by (id, h): they are shuffled once.
    starts = rows.join(asked, (F.col("id") == F.col("next_id")) & (F.col("h") == F.col("next_h")))
    starts = starts.select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), "n", "rank", "next_rank", F.substring("text", F.lit(1), quarter).alias("start"))
    starts = starts.dropDuplicates(["id", "h"])
    for h in hints:
        starts = starts.hint(h)
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - quarter), "start")
    return rows.join(starts, ["id", "h"]).select("id", "n", "rank", "next_rank", F.array("text", edited).alias("pair"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of ``docs``.

    The edited text replaces the last quarter (n_chars // 4 code points) by the first as many, or all, of the next document
    in ascending doc_id.  Rows of one doc_id follow in the order of a hash of their text, rows equal in both count as one in
    that order; a null doc_id comes first.  Null text is empty.  A table of one document is its own next.
    Empty table: no rows.  Extra columns are not read.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), "text")
    band, common = lexicon(rows)
    after = stored(successors(rows.select("id", "h", F.char_length("text").cast("long").alias("n"))), "successors")
    both = _with_edited(rows, after, "merge")
    both = both.select("id", "n", "rank", "next_rank", F.sha2(F.col("pair")[1].cast("binary"), 256).alias("edited_sha256"), _flagged(F.col("pair")).alias("terms"))
    # Terms above the band needn't be looked up.
    seldom = F.filter("terms", lambda t: ~t["term"].isin(common) if common else F.lit(True))
    # Texts with few terms to look up carry them all, as they may have none in the lexicon.
    terms_of = stored(both.withColumn("seldom", seldom).withColumn("terms", F.when(F.size("seldom") <= FEW, F.col("terms"))), "document-terms")
    looked_up = terms_of.select("rank", F.explode("seldom").alias("t")).select("rank", "t.term", "t.of").join(band.hint("merge"), "term")
    # Sets, as equal rows share a rank; one for each flag, as longs take the least room.
    found = looked_up.groupBy("rank").agg(*[F.collect_set(F.when(F.col("of") == k, F.col("term"))).alias(f"band{k}") for k in (1, 2, 3)])
    joined = terms_of.drop("seldom").join(found.hint("merge"), "rank", "left")

    def of_text(c: str, flag: int) -> Column:
        return F.transform(F.filter(c, lambda t: t["of"].bitwiseAND(F.lit(flag).cast("byte")) != 0), lambda t: t["term"])

    def printed(flag: int) -> Column:
        none = F.array().cast("array<bigint>")
        lexical = F.concat(F.coalesce(f"band{flag}", none), F.coalesce("band3", none))
        chosen = F.transform(F.array(lexical), lambda x: F.when(F.size(x) > 0, x).otherwise(of_text("terms", flag)))[0]
        return fingerprint(F.array_sort(chosen))

    done = stored(joined.select("id", "n", "rank", "next_rank", "edited_sha256", printed(1).alias("own"), printed(2).alias("changed")), "fingerprints")
    # The rare longer text without lexicon terms has its terms read once more.
    late = stored(done.filter(F.col("own").isNull() | F.col("changed").isNull()).select("rank").distinct(), "texts-without-lexicon")
    if not late.isEmpty():
        few = stored(after.join(late, "rank"), "late-successors")
        again = _with_edited(rows, few).dropDuplicates(["rank"]).select("rank", _flagged(F.col("pair")).alias("terms"))
        again = again.select("rank", *[fingerprint(F.array_sort(of_text("terms", k))).alias(f"all{k}") for k in (1, 2)])
        done = done.join(stored(again, "late-fingerprints"), "rank", "left").withColumn("own", F.coalesce("own", "all1")).withColumn("changed", F.coalesce("changed", "all2"))
    others = done.select(F.col("rank").alias("next_rank"), F.col("own").alias("next_print")).dropDuplicates(["next_rank"])
    found = done.join(others, "next_rank")
    own, changed = F.col("own"), F.col("changed")
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", written(own).alias("fingerprint"),
                        written(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, F.col("next_print")).alias("near_next"))
