"""Rows that hold any value of a pick list given as a DataFrame of any size (O-27 as data).

Every value is filed under one of its n-grams of bytes, the one that is in the list least often; a row is looked up by the gram at each of
its bytes, and where one meets, the text around it is tested by `contains`.  Values no longer than a gram are filed under themselves
and met by grams of their own length, so that a gram of theirs that meets is a match.  No value stands in the plan.  A row has grams
of several lengths for every byte, so that side is never sent anywhere whole: a Bloom filter of the grams' first bytes, held by
every task, tells at which bytes one may begin; every task holds a list of up to HELD_BYTES; of a longer one it holds a Bloom
filter of the grams, and only the rows' grams that pass are shuffled, with the text around them where that is needed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import scratch_root

KEY = ("source_file", "source_line")
#: Bytes of the grams that values are filed under, where they are that long, and of their beginnings that are looked up first.
GRAM, HEAD = 8, 4
#: Size up to which a filed list is broadcast whole; each of its rows counts as ROW_BYTES beside its text.
HELD_BYTES = 16 * 1024 * 1024
ROW_BYTES = 48
#: Words of 64 bits of a Bloom filter at most, each a row that is broadcast, and bits that a gram sets in its word.
MOST_WORDS, BITS = 1 << 20, 3


def _filed(values: DataFrame) -> DataFrame:
    """(gram, value): each distinct value of at least one character under one of its grams."""
    text = F.col(values.columns[0]).cast("string")
    distinct = values.select(text.alias("value"), text.cast("binary").alias("_text")).where(F.octet_length("_text") > 0).distinct()
    length = F.octet_length("_text")
    size = F.least(length, F.lit(GRAM))
    placed = distinct.select("value", "_text", size.alias("_size"), F.explode(F.sequence(F.lit(1), length - size + 1)).alias("_at"))
    pairs = placed.select("value", F.substring("_text", F.col("_at"), F.col("_size")).alias("gram"))
    shared = pairs.select("gram", "value", F.count(F.lit(1)).over(Window.partitionBy("gram")).alias("n"))
    return shared.groupBy("value").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")).select("gram", "value")


def _bloom(words: int) -> tuple[Column, Column]:
    """The word of a Bloom filter that a `gram` belongs to, and its bits there."""
    hashed = F.xxhash64("gram")
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(hashed, 6 * k), F.lit(64)).cast("int")) for k in range(BITS)]
    return F.pmod(F.shiftrightunsigned(hashed, 6 * BITS), F.lit(words)), functools.reduce(Column.bitwiseOR, bits)


def _passing(rows: DataFrame, grams: DataFrame, n_grams: int) -> DataFrame:
    """Rows whose `gram` is among the n different `grams`, and few others: a filter of up to MOST_WORDS rows is broadcast."""
    words = min(MOST_WORDS, 1 << max(6, (n_grams // 2).bit_length()))
    word, bits = _bloom(words)
    held = grams.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_held"))
    looked_up = rows.select("*", word.alias("_word"), bits.alias("_bits")).join(F.broadcast(held), "_word")
    return looked_up.where(F.col("_held").bitwiseAND(F.col("_bits")) == F.col("_bits")).select(*rows.columns)


def _exploded(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Each row with every one of the sizes, and the `gram` of that many bytes at its place."""
    sized = rows.select(*KEY, "_text", "_at", F.explode(F.array(*map(F.lit, sizes))).alias("_size"))
    return sized.where(F.col("_at") + F.col("_size") <= F.octet_length("_text") + 1).select("*", F.substring("_text", F.col("_at"), F.col("_size")).alias("gram"))


def _hits(rows: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """(source_file, source_line, value) of `matches`, some of them more than once."""
    scratch_root(rows.sparkSession)
    filed = _filed(values).checkpoint()
    sizes = filed.groupBy(F.octet_length("gram").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + F.octet_length("value") + ROW_BYTES).alias("bytes"), F.max(F.octet_length("value")).alias("longest")).collect()
    if not sizes:  # at most GRAM rows
        return rows.select(*KEY, F.lit("").alias("value")).limit(0)
    longest, all_grams = max(r["longest"] for r in sizes), sum(r["n"] for r in sizes)
    at, size, each = F.col("_at"), F.col("_size"), sorted(r["size"] for r in sizes)
    placed = (rows.select(*KEY, F.col(col).cast("binary").alias("_text")).where(F.octet_length("_text") > 0)
              .select("*", F.explode(F.sequence(F.lit(1), F.octet_length("_text"))).alias("_at")))
    heads = filed.select(F.substring("gram", 1, HEAD).alias("gram")).distinct()
    begun = _passing(_exploded(placed, sorted({min(n, HEAD) for n in each})), heads, all_grams)
    # Where a gram of HEAD bytes or more may begin, all such sizes are tried; a shorter one has been told by its size.
    long = F.array(*[F.lit(n) for n in each if n >= HEAD])
    begun = begun.select(*KEY, "_text", at, F.explode(F.when(size < HEAD, F.array(size)).otherwise(long)).alias("_size"))
    met = begun.where(at + size <= F.octet_length("_text") + 1).select("*", F.substring("_text", at, size).alias("gram"))
    # A value of this list that holds the gram begins and ends within this much of it; one shorter than GRAM is the gram.
    start = F.greatest(F.lit(1), at + size - longest)
    around = F.when(size < GRAM, F.col("gram")).otherwise(F.substring("_text", start, at + longest - start))
    if sum(r["bytes"] for r in sizes) <= HELD_BYTES:
        found = met.join(F.broadcast(filed), "gram").where(F.contains(around, F.col("value").cast("binary")))
    else:
        passing = _passing(met, filed, all_grams).select(*KEY, "gram", around.alias("_around"))
        # Spark takes the exploded side for as small as the rows, so the kind of join is given.
        found = passing.join(filed.hint("merge"), "gram").where(F.contains(F.col("_around"), F.col("value").cast("binary")))
    return found.select(*KEY, "value")


def matches(rows: DataFrame, values: DataFrame, col: str = "raw") -> DataFrame:
    """(source_file, source_line, value): every value of the list that a row's text holds."""
    return _hits(rows, values, col).distinct()


def containing_any(rows: DataFrame, values: DataFrame, col: str = "raw") -> DataFrame:
    """The rows whose text holds at least one value; rows are told apart by file and line.  NULL and empty values match nothing."""
    held = _hits(rows, values, col).select(*KEY).distinct()
    return rows.join(held.hint("merge"), list(KEY), "left_semi").select(*rows.columns)
