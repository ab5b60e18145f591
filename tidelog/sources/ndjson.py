"""NDJSON line scan with absolute line numbers (O-4, O-5, O-6, O-10, O-11, O-17).

Line numbering without a whole-file sort or a shuffle of the lines:

* the `text` source splits every file into byte ranges (`_metadata.file_block_start`); a line
  belongs to exactly one split and each split is read in order by one task;
* job 1 counts lines per split (a map-side combined aggregate: one row per split) and turns the
  counts into a running base per file with a window over the *split* rows only;
* job 2 re-reads the lines, joins that small split table back by broadcast and numbers each
  line as base + its position inside the split.

Position inside a split comes from `monotonically_increasing_id()` taken right at the scan:
rows of one split are contiguous and ordered inside a task, so position = id - min(id of split).
Both jobs scan the same relation (same file listing) with the split size pinned, so both see the
same splits in the same tasks.  The split table has one row per split, bounded by the listing:
at most sum(ceil(size / split_bytes)) rows, which the caller checks before loading a group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions import extract as X
from tidelog.session import kept_columns

#: A split by its object as the scan names it; what the listing calls the object is told once a split, not once a line.
SPLIT_COLS = ["scanned_path", "split_start"]
#: Objects that the reader decompresses, whose size tells nothing about their lines.
COMPRESSED = r"\.(gz|bz2|zst|snappy|lz4|deflate)$"


def object_path() -> Column:
    """Path of the scanned object as the listing reports it: `_metadata` percent-encodes special characters."""
    return F.url_decode(F.replace(F.col("scanned_path"), F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path that Spark's readers take as it is, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def scan_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line of the files as (scanned_path, split_start, rid, value); '\\n' separated only."""
    df = spark.read.option("lineSep", "\n").text([literal_path(p) for p in paths])
    return df.select(
        F.col("_metadata.file_path").alias("scanned_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("rid"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value"),
    )


def split_table(lines: DataFrame) -> DataFrame:
    """One row per split: running line base (0 for a file's first split alone), first id, plus per-file totals and longest line."""
    counted, named, short, out = _split_columns()
    return lines.groupBy(*SPLIT_COLS).agg(*counted).select(*named).select(*short).select(*out)


@kept_columns
def _split_columns() -> tuple[list, ...]:
    """Sums of a split's lines, and the three projections that make a row of the split table of them."""
    blank = X.is_blank(X.strip_cr(F.col("value")))
    counted = [
        F.count(F.lit(1)).alias("n_lines"),
        F.min("rid").alias("rid0"),
        F.max(F.octet_length("value")).alias("max_len"),
        F.count_if(~blank).alias("n_nonblank"),
        F.sum(F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        F.max("file_size").alias("file_size"),
        F.min(F.col("rid") * 2 + blank.cast("int")).alias("_first"),  # a number: lines are summed up by hash, not sorted
    ]
    named = [object_path().alias("source_path"), F.col("*"), (F.col("_first") % 2 == 1).alias("first_blank")]
    # The reader swallows a byte-order mark: the lines and their ends are then three bytes short of the file.  The mark stands
    # before the first value, so that line isn't JSON, nor blank.
    marked = ((F.col("_short") == 3) | (F.col("_short") == 2)) & ~F.col("source_path").rlike(COMPRESSED)
    w = Window.partitionBy("scanned_path").orderBy("split_start")
    running = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("scanned_path")
    short = [F.col("*"), (F.col("file_size") - F.sum("n_bytes").over(whole)).alias("_short")]
    hidden = F.when(marked & F.col("first_blank") & (F.col("split_start") == 0), 1).otherwise(0)
    out = [
        *map(F.col, ("source_path", *SPLIT_COLS, "rid0")), marked.alias("bom"),
        F.coalesce(F.sum("n_lines").over(running), F.lit(0)).alias("base"),
        F.count(F.lit(1)).over(whole).alias("n_splits"),
        F.sum("n_lines").over(whole).alias("file_lines"),
        F.sum(F.col("n_nonblank") + hidden).over(whole).alias("file_nonblank"),
        F.max("max_len").over(whole).alias("file_max_len"),
    ]
    return counted, named, short, out


def numbered_lines(lines: DataFrame, splits: DataFrame, broadcast_splits: bool) -> DataFrame:
    """Lines of files that pass the line-length rule, with their 1-based line number and the load's time."""
    not_marked, out = _number_columns()
    good = splits.where(F.col("file_max_len") < X.MAX_LINE_BYTES).select("source_path", *SPLIT_COLS, "rid0", "base", "bom", "ingested_at")
    if broadcast_splits:
        good = F.broadcast(good)
    return lines.join(good, SPLIT_COLS, "inner").where(not_marked).select(*out)


@kept_columns
def _number_columns() -> tuple[Column, list]:
    not_marked = ~(F.col("bom") & (F.col("split_start") == 0) & (F.col("rid") == F.col("rid0")))
    line = (F.col("base") + (F.col("rid") - F.col("rid0")) + 1).cast("int")
    return not_marked, [F.col("source_path"), line.alias("source_line"), X.strip_cr(F.col("value")).alias("raw"), F.col("ingested_at")]


def parse_rows(numbered: DataFrame, fields, root_qualified: str, unit: str = "day") -> DataFrame:
    """Valid rows in table layout (O-17): bookkeeping columns, fields, then event_date.

    The load's time is a column of the lines: as a constant it would stand in the generated code, which Spark then compiles anew
    for every load, and the JVM begins by interpreting it."""
    filled, parsed, valid, wanted, day = _row_columns(tuple(fields), root_qualified, unit)
    staged = numbered.where(filled).select(*parsed).where(valid).select(*wanted)
    return X.extract_df(staged, "_s", fields, BOOKKEEPING).withColumn("event_date", day)


#: Columns of a row beside the fields.
BOOKKEEPING = ["raw", "source_file", "source_line", "ingested_at"]


@kept_columns
def _row_columns(fields: tuple, root_qualified: str, unit: str) -> tuple:
    raw, v = F.col("raw"), F.col("_v")
    parsed = [raw, relative_name(root_qualified).alias("source_file"), F.col("source_line"), F.col("ingested_at"), X.parse_line(raw).alias("_v")]
    wanted = [*map(F.col, BOOKKEEPING), X.key_struct(v, X.wanted_keys(fields)).alias("_s")]
    return ~X.is_blank(raw), parsed, X.is_valid(v, raw), wanted, X.event_date(F.col("time"), F.col("ingested_at"), unit)


def relative_name(root_qualified: str) -> Column:
    """Object name relative to the source root, as the listing reports it."""
    prefix = root_qualified.rstrip("/") + "/"
    return F.when(F.col("source_path").startswith(prefix),
                  F.substring(F.col("source_path"), len(prefix) + 1, 1 << 30)).otherwise(F.col("source_path"))


def parse_lines_df(lines: DataFrame, fields, raw_col: str = "raw") -> DataFrame:
    """Extraction over an existing DataFrame of lines (any extra columns kept), valid rows only."""
    v = X.parse_line(F.col(raw_col))
    keep = [c for c in lines.columns]
    staged = lines.where(~X.is_blank(F.col(raw_col))).withColumn("_v", v)
    staged = staged.where(X.is_valid(F.col("_v"), F.col(raw_col)))
    staged = staged.select(*keep, X.key_struct(F.col("_v"), X.wanted_keys(fields)).alias("_s"))
    return X.extract_df(staged, "_s", fields, keep)


def classify_lines_df(lines: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds `blank` and `valid` flags (O-10, O-11) to a DataFrame of lines."""
    raw = F.col(raw_col)
    v = X.parse_line(raw)
    return lines.select("*", X.is_blank(raw).alias("blank"),
                        (~X.is_blank(raw) & X.is_valid(v, raw)).alias("valid"))
