"""Which data files can't hold a text: a Bloom filter of character n-grams per data file (O-21, O-22).

    <table>/ngrams/  (bucket, event_date, data_file, bits)   bits of one bucket of a file's filter; bucket 0 marks the file as covered

A filter has BUCKETS bitmaps of 32,768 bits, built by Spark's own bitmap aggregates over the grams of every line.  It covers the
raw line and, where JSON escapes make a field's value differ from its text in the line, the fields as well.  A file may be left
unread where one gram of the needle isn't in its filter; a file without a filter is always read.  `enable` makes a source
keep filters; loads and rewrites then write them before their files become visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import LogStore
from tidelog.sources import fs
from tidelog.spec import SourceSpec

#: Characters of a gram, and bitmaps of a file's filter: 64 of them are 2 million bits or 256 KB.
GRAM = 4
BUCKETS = 64
#: Bits of one of Spark's bitmaps.
BITMAP_BITS = 32_768
#: Grams of a needle that are looked up; fewer only skip less.
MOST_GRAMS = 64

NAME = "ngrams"
SCHEMA = "bucket int, event_date date, data_file string, bits binary"


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct substrings of `size` characters; none of a shorter or NULL text."""
    chars = F.split(text, "")
    last = F.char_length(text) - F.lit(size)
    joined = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]))
    return F.when(last >= 0, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def _bit(gram: Column) -> Column:
    """Number of a gram's bit, from 1."""
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS * BITMAP_BITS)) + F.lit(1)


def _at(store: LogStore, sid: str) -> str:
    return f"{store.table_dir(sid)}/{NAME}"


def table(store: LogStore, spec: SourceSpec) -> DataFrame:
    return store.spark.read.schema(SCHEMA).parquet(_at(store, spec.id))


def enabled(store: LogStore, sid: str) -> bool:
    return fs.exists(store.spark, _at(store, sid))


def enable(store: LogStore, spec_or_id) -> None:
    """Keep filters for a source from now on, and build those of the data files it has."""
    spec = spec_or_id if isinstance(spec_or_id, SourceSpec) else store.get(spec_or_id)
    if enabled(store, spec.id):
        return
    has_rows = any(n.startswith("event_date=") for n in fs.Handle(store.spark, store.root).names(store.data_dir(spec.id)))
    if has_rows:
        new = _at(store, spec.id) + ".new"
        filters(spec, store.table(spec)).write.mode("overwrite").parquet(new)
        fs.rename(store.spark, new, _at(store, spec.id))
    else:
        fs.mkdirs(store.spark, _at(store, spec.id))


def filters(spec: SourceSpec, rows: DataFrame) -> DataFrame:
    """The filters of the files that the rows lie in.

    A file's different bits are found before its bitmaps are put together, which Spark does over sorted rows.  Lines of plain ASCII
    without escapes, whose bytes are their characters, are cut byte by byte."""
    plain = ~F.col("raw").contains("\\") & (F.octet_length("raw") == F.char_length("raw"))
    cut = (rows.where(plain & (F.octet_length("raw") >= GRAM)).select("event_date", F.col("_metadata.file_name").alias("data_file"), F.col("raw").cast("binary").alias("_text"))
           .select("event_date", "data_file", "_text", F.explode(F.sequence(F.lit(1), F.octet_length("_text") - (GRAM - 1))).alias("_at"))
           .select("event_date", "data_file", _bit(F.substring("_text", F.col("_at"), F.lit(GRAM))).alias("bit")))
    fields = [F.col(c) for c in spec.other_columns] + [F.col("level")]
    texts = F.when(F.col("raw").contains("\\"), F.array(F.col("raw"), *fields)).otherwise(F.array(F.col("raw")))
    hashed = F.transform(F.flatten(F.transform(texts, lambda t: grams(t))), _bit)
    covered = F.array(F.lit(0).cast("bigint"))
    others = F.when(F.coalesce(plain, F.lit(False)), covered).otherwise(F.array_distinct(F.concat(covered, hashed)))
    bits = rows.select("event_date", F.col("_metadata.file_name").alias("data_file"), F.explode(others).alias("bit")).unionByName(cut).distinct()
    one = F.greatest(F.col("bit"), F.lit(1))
    return (bits.groupBy(F.when(F.col("bit") == 0, 0).otherwise(F.bitmap_bucket_number(one)).cast("int").alias("bucket"), "event_date", "data_file")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
            .hint("rebalance").sortWithinPartitions("bucket", "data_file"))


def append(store: LogStore, spec: SourceSpec, staged: str) -> None:
    """Filters of staged data files, where the source keeps them; to be called before the files become visible."""
    if enabled(store, spec.id) and any(n.startswith("event_date=") for n in fs.Handle(store.spark, staged).names(staged)):
        filters(spec, store.spark.read.schema(spec.storage_schema()).parquet(staged)).write.mode("append").parquet(_at(store, spec.id))


def needles(spec: SourceSpec, fields: dict | None = None, text: str = "") -> list[str]:
    """Texts that every matching row holds in its line or in a field."""
    known = set(spec.other_columns)
    return [t for t in [text, *(v for c, v in sorted((fields or {}).items()) if c in known)] if t and len(t) >= GRAM]


def _bits_of(spark: SparkSession, texts: list[str]) -> list[int]:
    found = list(dict.fromkeys(t[k:k + GRAM] for t in texts for k in range(len(t) - GRAM + 1)))[:MOST_GRAMS]
    return sorted({r[0] for r in spark.createDataFrame([(g,) for g in found], "g string").select(_bit(F.col("g"))).collect()})


def files_without(store: LogStore, spec: SourceSpec, texts: list[str]) -> DataFrame | None:
    """(event_date, data_file) of covered files where some gram of the texts doesn't occur; None where nothing can be told."""
    if not texts or not enabled(store, spec.id):
        return None
    wanted: dict[int, list[int]] = {}
    for bit in _bits_of(store.spark, texts):
        wanted.setdefault((bit - 1) // BITMAP_BITS + 1, []).append((bit - 1) % BITMAP_BITS)
    held = F.lit(0)
    for bucket, places in wanted.items():
        here = F.lit(0)
        for p in places:
            byte = F.conv(F.hex(F.substring("bits", p // 8 + 1, 1)), 16, 10).cast("int")
            here = here + F.shiftright(byte, p % 8).bitwiseAND(F.lit(1))
        held = F.when(F.col("bucket") == bucket, here).otherwise(held)
    rows = table(store, spec).where(F.col("bucket").isin(0, *wanted))
    # A file that was described twice has equal rows: the greatest of them, then the sum over buckets.
    once = rows.groupBy("event_date", "data_file", "bucket").agg(F.max(held).alias("n"))
    found = once.groupBy("event_date", "data_file").agg(F.sum("n").alias("n"), F.max(F.col("bucket") == 0).alias("covered"))
    return found.where(F.col("covered") & (F.col("n") < sum(map(len, wanted.values())))).select("event_date", "data_file")
