"""Registered queries over sources derived from the supplied tables, and their SQL oracles.

Each query takes (spark, sf_dir) and returns a DataFrame; the oracle is DuckDB SQL over the same
parquet tables that computes the expected columns directly from the input rows (no JSON parsing
of generated lines, except the key/value detail view).  Column names and types match pairwise.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import extract as X
from tidelog.operators import load as L
from tidelog.operators import ngrams, pages, picklist, placement
from tidelog.operators import partitions as P
from tidelog.operators import retention as R
from tidelog.operators import search as Q
from tidelog.operators import stats as S
from tidelog.plans import derived as D
from tidelog.plans.maintenance import due_predicate
from tidelog.catalog import LogStore, upsert_latest
from tidelog.sources import ndjson as N
from tidelog.spec import Field

# Small split size for the shared events source, so every file is numbered across several splits.
EVENT_SPLIT_BYTES = 32 * 1024

# --- DuckDB: the generated event lines and their expected columns -----------------------------
EV_CTE = r"""
ev AS (
  SELECT event_id AS id, ts, user_id, event_type,
    event_id % 10 AS c, (event_id // 10) % 2 AS alt,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG'
      WHEN 'purchase' THEN 'WARN' ELSE 'info' END AS lvl,
    event_type || ' user_' || CAST(user_id AS VARCHAR) || ' #' || CAST(event_id AS VARCHAR) AS msg0,
    'svc-' || CAST(user_id % 7 AS VARCHAR) AS topic0,
    'A' || CAST(user_id AS VARCHAR) AS acc0,
    'logs/app-' || lpad(CAST(event_id // 1000 AS VARCHAR), 5, '0') || '.ndjson' AS source_file,
    CAST(row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS INTEGER) AS source_line
  FROM events),
lines AS (
  SELECT *, CASE c
    WHEN 0 THEN '{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '-06:00","level":"' || lvl || '","msg":"'
      || msg0 || '","topic":"' || topic0 || '","accession":"' || acc0 || '","study_uid":"S' || CAST(id AS VARCHAR)
      || '","kind":"' || event_type || '"}'
    WHEN 1 THEN '{":time":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","level":"' || lvl || '","msg":"' || msg0
      || '",":topic":"gateway","topic":"' || topic0 || '"}'
    WHEN 2 THEN '{"time":' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) || ',"level":"' || lvl || '","msg":"' || msg0
      || '","accession":"' || acc0 || '","kind":"' || event_type || '"}'
    WHEN 3 THEN '{"time":' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || ',"level":"' || lvl || '","msg":"' || msg0
      || ' 100%","accession":' || CAST(user_id AS VARCHAR) || ',"topic":"' || topic0 || '"}'
    WHEN 4 THEN CASE WHEN alt = 0 THEN 'plain text event ' || CAST(id AS VARCHAR)
      ELSE '{"level":"INFO","msg":"x"} trailing ' || CAST(id AS VARCHAR) END
    WHEN 5 THEN CASE WHEN alt = 0 THEN '' ELSE '   ' END
    WHEN 6 THEN '{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","level":null,"msg":"' || msg0
      || '","topic":"' || topic0 || '"}'
    WHEN 7 THEN '{"time":' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.5,"level":' || CAST(user_id % 5 AS VARCHAR)
      || ',"msg":"' || msg0 || '"}'
    WHEN 8 THEN CASE WHEN alt = 0 THEN '{"time":"' || strftime(ts, '%Y-%m-%d') || '",":time":"'
      || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","level":"' || lvl || '","msg":"' || msg0 || '"}'
      ELSE '{"time":null,":time":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","level":"' || lvl
      || '","msg":"' || msg0 || '"}' END
    ELSE CASE WHEN alt = 0 THEN '{"level":"' || lvl || '","msg":"' || msg0 || '","study_uid":"S'
      || CAST(id AS VARCHAR) || '"}'
      ELSE '{"time":"' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '","level":"' || lvl || '","msg":"' || msg0
      || '"}' END
  END AS raw FROM ev),
rows AS (
  SELECT id, c, alt, ts, event_type, source_file, source_line, raw,
    CASE WHEN c IN (0, 6, 8) THEN ts WHEN c IN (1, 2) THEN date_trunc('second', ts)
      WHEN c = 3 THEN date_trunc('millisecond', ts)
      WHEN c = 7 THEN date_trunc('second', ts) + INTERVAL 500 MILLISECOND END AS time,
    CASE WHEN c = 6 THEN '' WHEN c = 7 THEN NULL ELSE lvl END AS level,
    CASE WHEN c = 3 THEN msg0 || ' 100%' ELSE msg0 END AS msg,
    CASE WHEN c IN (0, 3, 6) THEN topic0 WHEN c = 1 THEN 'gateway' END AS topic,
    CASE WHEN c IN (0, 2) THEN acc0 END AS accession,
    CASE WHEN c = 0 OR (c = 9 AND alt = 0) THEN 'S' || CAST(id AS VARCHAR) END AS study_uid
  FROM lines WHERE c NOT IN (4, 5))
"""

PAGE_ORDER_SQL = "time DESC NULLS LAST, source_file, source_line"
FIELDS_TEXT_SQL = ("concat_ws(';', 'accession=' || accession, 'msg=' || msg, 'study_uid=' || study_uid, "
                   "'topic=' || topic) AS fields_text")


def _ev(sql: str) -> str:
    return "WITH " + EV_CTE + sql


# --- Spark helpers -----------------------------------------------------------------------------
def _events(spark: SparkSession, sf: str):
    store, spec, objects = D.build_source(spark, "events", sf, split_bytes=EVENT_SPLIT_BYTES)
    return store, spec, store.table(spec)


def _fields_text(m: Column) -> Column:
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _page_cols(df: DataFrame) -> DataFrame:
    return df.select("time", "level", _fields_text(F.col("fields")).alias("fields_text"), "source_file",
                     "source_line")


def _keys(df: DataFrame) -> DataFrame:
    return df.select("source_file", "source_line")


def _text_lines(spark: SparkSession, objects: str) -> DataFrame:
    root = D.fs.qualify(spark, objects).rstrip("/") + "/"
    df = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(objects)
    name = F.substring(F.col("_metadata.file_path"), len(root) + 1, 1 << 30)
    return df.select(name.alias("source_file"), F.col("value"))


# --- queries -----------------------------------------------------------------------------------
def q_extract_fields(spark, sf):
    _, _, t = _events(spark, sf)
    return t.select("source_file", "source_line", "time", "level", "msg", "topic", "accession", "study_uid")


def q_line_numbers(spark, sf):
    _, _, t = _events(spark, sf)
    return t.select("source_file", "source_line", "raw")


def q_load_counts(spark, sf):
    store, spec, objects = D.build_source(spark, "events", sf, split_bytes=EVENT_SPLIT_BYTES)
    lines = _text_lines(spark, objects).select("source_file", X.strip_cr(F.col("value")).alias("raw"))
    cls = N.classify_lines_df(lines)
    counts = cls.groupBy("source_file").agg(
        F.count_if(~F.col("valid") & ~F.col("blank")).cast("bigint").alias("lines_skipped"),
        F.count_if(F.col("blank")).cast("bigint").alias("blank_lines"))
    m = store.manifest(spec.id).select(F.col("file_name").alias("source_file"), "rows_ingested")
    return m.join(counts, "source_file", "left")


def q_crlf_lines(spark, sf):
    store, spec, objects = D.build_source(spark, "events", sf, split_bytes=EVENT_SPLIT_BYTES)
    lines = _text_lines(spark, objects)
    a = lines.groupBy("source_file").agg(F.count_if(F.col("value").endswith("\r")).cast("bigint").alias("n_crlf"))
    b = store.table(spec).groupBy("source_file").agg(
        F.count_if(F.col("raw").contains("\r")).cast("bigint").alias("n_cr_in_table"))
    return a.join(b, "source_file", "inner")


def q_wall_clock_time(spark, sf):
    _, _, t = _events(spark, sf)
    return t.where(F.col("raw").rlike('"time":"|":time":"')).select("source_file", "source_line", "time")


def q_epoch_time(spark, sf):
    _, _, t = _events(spark, sf)
    return t.where(F.col("raw").rlike('"time":[0-9]')).select("source_file", "source_line", "time")


def q_time_range(spark, sf):
    _, spec, t = _events(spark, sf)
    df = Q.filtered(t, spec, time_from=datetime(2024, 1, 5), time_to=datetime(2024, 1, 12, 12))
    return df.select("source_file", "source_line", "time")


def q_level_equals(spark, sf):
    _, spec, t = _events(spark, sf)
    return Q.filtered(t, spec, level="ERROR").select("source_file", "source_line", "level")


def q_field_contains(spark, sf):
    _, spec, t = _events(spark, sf)
    return _keys(Q.filtered(t, spec, fields={"msg": "0%", "topic": "svc-"}))


def q_field_underscore(spark, sf):
    _, spec, t = _events(spark, sf)
    return _keys(Q.filtered(t, spec, fields={"msg": "r_1"}))


def q_free_text(spark, sf):
    _, spec, t = _events(spark, sf)
    return _keys(Q.filtered(t, spec, text="S1"))


def q_document_text(spark, sf):
    store, spec, _ = D.build_source(spark, "documents", sf)
    t = store.table(spec)
    df = Q.filtered(t, spec, fields={"msg": "the "})
    return df.select(F.col("doc").cast("bigint").alias("doc_id"), F.octet_length("msg").cast("bigint").alias("n_bytes"))


def q_unknown_field_ignored(spark, sf):
    _, spec, t = _events(spark, sf)
    return _keys(Q.filtered(t, spec, level="WARN", fields={"nope": "x", "time": "2024", "level": "ERROR", "msg": ""}))


def _page(store: LogStore, spec, offset: int = 0, size: int = Q.PAGE_SIZE, cursor: tuple | None = None, **kw) -> DataFrame:
    """A page and its look-ahead row, by the time index of the data files."""
    return _page_cols(pages.as_frame(store, pages.page(store, spec, offset, size + 1, cursor, **kw).rows))


def q_newest_page(spark, sf):
    store, spec, _ = _events(spark, sf)
    return _page(store, spec)


def q_second_page(spark, sf):
    store, spec, _ = _events(spark, sf)
    return _page(store, spec, 100)


def q_rare_needle_page(spark, sf):
    """A page for a needle that few rows hold, and how often the search opened any one data file."""
    store, spec, _ = _events(spark, sf)
    page = pages.page(store, spec, text=" #77")
    read = [f for block in page.blocks for f in block]
    most = max((read.count(f) for f in read), default=0)
    return _page_cols(pages.as_frame(store, page.rows)).withColumn("reads_of_a_file", F.lit(most).cast("bigint"))


def q_combined_search(spark, sf):
    """One search with every kind of filter, and whether more rows follow."""
    store, spec, _ = _events(spark, sf)
    res = pages.page(store, spec, time_from=datetime(2024, 1, 2), time_to=datetime(2024, 1, 28), level="ERROR", fields={"msg": "user_"}, text="error")
    rows = [(r["time"], r["level"], r["source_file"], r["source_line"], res.has_more) for r in res.rows]
    return spark.createDataFrame(rows, "time timestamp_ntz, level string, source_file string, source_line int, has_more boolean")


def q_original_lines(spark, sf):
    """The original line of each of the newest three rows, by the point lookup."""
    store, spec, t = _events(spark, sf)
    keys = [(r["source_file"], r["source_line"]) for r in pages.page(store, spec, size=3).rows]
    return spark.createDataFrame([(f, n, Q.raw_line(t, f, n)) for f, n in keys], "source_file string, source_line int, raw string")


def _nonnull_count(t: DataFrame) -> int:
    return t.where(F.col("time").isNotNull()).count()


def q_deep_page(spark, sf):
    _, spec, t = _events(spark, sf)
    return _page_cols(Q.page(t, spec, max(0, _nonnull_count(t) - 50)))


def q_keyset_page(spark, sf):
    """Cursor = last row of the page that ends 50 rows before the NULL-time tail; the next page
    crosses from timed rows into the NULL-time rows."""
    store, spec, t = _events(spark, sf)
    k = max(0, _nonnull_count(t) - 51)
    cur = Q.page(t, spec, k, size=0).collect()[0]
    return _page(store, spec, cursor=(cur["time"], cur["source_file"], cur["source_line"]))


def q_end_of_day_bound(spark, sf):
    _, spec, t = _events(spark, sf)
    day = date(2024, 1, 3)
    df = Q.filtered(t, spec, time_from=Q.end_of_day_bound(day), time_to=Q.end_of_day_bound(day, end_of_day=True))
    return df.select("source_file", "source_line", "time")


def q_fields_map(spark, sf):
    _, spec, t = _events(spark, sf)
    return t.select("source_file", "source_line", _fields_text(X.fields_map(spec.other_columns)).alias("fields_text"))


def q_detail_kv(spark, sf):
    _, _, t = _events(spark, sf)
    return Q.detail_kv(t)


def q_clicked_value(spark, sf):
    _, spec, t = _events(spark, sf)
    pick = (Q.filtered(t, spec, level="ERROR").where(F.col("accession").isNotNull())
            .orderBy(*Q.order()).select("accession").limit(1))
    value = pick.collect()[0]["accession"]
    return _keys(t.where(Q.contains_any([value])))


def q_pick_list(spark, sf):
    """Rows whose line holds any accession that occurs in the table, given as a DataFrame."""
    _, _, t = _events(spark, sf)
    return _keys(picklist.containing_any(t, t.where("accession is not null").select("accession")))


def q_pick_list_matches(spark, sf):
    """Every value of a mixed list that a line holds: of several lengths, one that no line holds, NULL and the empty text."""
    _, _, t = _events(spark, sf)
    values = spark.read.parquet(f"{sf}/events.parquet").select(
        F.when(F.col("event_id") % 50 == 0, _cat("user_", F.col("user_id"), " #", F.col("event_id"))).when(F.col("event_id") % 50 == 1, F.col("event_type"))
        .when(F.col("event_id") % 50 == 2, _cat("S", F.col("user_id"))).when(F.col("event_id") % 50 == 3, F.lit("")).when(F.col("event_id") % 50 == 4, F.lit("no such")))
    return picklist.matches(t, values).groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))


def _cat(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def q_look_up_lines(spark, sf):
    """The original lines of every 37th event, asked for as a table of files and line numbers."""
    store, spec, _ = _events(spark, sf)
    ev = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_id") % 37 == 0)
    keys = ev.select(D.event_file_name(F.floor(F.col("event_id") / D.EVENTS_PER_FILE).cast("bigint")).alias("source_file"),
                     (F.col("event_id") % D.EVENTS_PER_FILE + 1).cast("int").alias("source_line"))
    return placement.lines(store, spec, keys)


def q_text_skipping(spark, sf):
    """Rows with a rare needle by way of the n-gram filters, and whether these left files unopened that hold none."""
    store, spec, _ = _items(spark, sf)
    ngrams.enable(store, spec)
    needle = "order 7 line 1"
    out = ngrams.files_without(store, spec, [needle])
    skipped = out.count()
    page = pages.page(store, spec, size=1000, text=needle)
    read = sum(map(len, page.blocks))
    rows = [(r["source_file"], r["source_line"], r["time"], skipped > 0 and read > 0) for r in page.rows]
    return spark.createDataFrame(rows, "source_file string, source_line int, time timestamp_ntz, files_skipped boolean").select("time", "files_skipped")


def q_distinct_levels(spark, sf):
    _, _, t = _events(spark, sf)
    return Q.distinct_levels(t)


def q_severity_bucket(spark, sf):
    _, _, t = _events(spark, sf)
    return Q.with_severity(t).groupBy("severity").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def q_raw_line(spark, sf):
    store, spec, t = _events(spark, sf)
    picks = store.manifest(spec.id).select(F.col("file_name").alias("source_file"), F.lit(1).alias("source_line"))
    return t.join(picks, ["source_file", "source_line"], "left_semi").select("source_file", "source_line", "raw")


def q_row_count(spark, sf):
    _, _, t = _events(spark, sf)
    return spark.createDataFrame([(S.row_count(t),)], "n_rows bigint")


def q_time_bounds(spark, sf):
    _, _, t = _events(spark, sf)
    return S.time_bounds(t).select("min_time", "max_time", "n_rows")


def _items(spark, sf, fresh=False, **kw):
    store, spec, objects = D.build_source(spark, "lineitem", sf, cache=not fresh, **kw)
    return store, spec, objects


def q_range_counts(spark, sf):
    store, spec, _ = _items(spark, sf)
    return S.range_counts(store.table(spec)).select(F.to_date("bucket").alias("day"), "n_rows")


CUTOFF_FRACTIONS = (0.1, 0.33, 0.5)


def q_oldest_cutoff(spark, sf):
    store, spec, _ = _items(spark, sf)
    t = store.table(spec)
    n = S.row_count(t)
    rows = [(f, S.oldest_cutoff_micros(t, n, f, spec.partition_unit)) for f in CUTOFF_FRACTIONS]
    df = spark.createDataFrame(rows, "fraction double, us bigint")
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return df.select("fraction", F.timestamp_add("MICROSECOND", F.col("us"), epoch0).alias("cutoff"))


DELETE_CUTOFF = datetime(1995, 6, 17, 12, 0, 0)


def q_delete_older(spark, sf):
    store, spec, _ = _items(spark, sf, fresh=True)
    deleted = R.delete_older_than(store, spec, DELETE_CUTOFF)
    t = store.table(spec)
    return (t.groupBy("level").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.min("time").alias("min_time"))
            .withColumn("n_deleted", F.lit(deleted).cast("bigint")))


RETENTION_NOW = datetime(1998, 6, 1)
#: The values of `o_orderpriority`.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
RETENTION_DAYS = 1000


def q_retention_policy(spark, sf):
    store, spec, _ = _items(spark, sf, fresh=True)
    spec.retention_days = RETENTION_DAYS
    store.save(spec)
    res = R.apply_retention(store, spec, RETENTION_NOW)
    remaining = S.row_count(store.table(spec))
    return spark.createDataFrame([(res.rows_deleted, res.compacted, remaining)],
                                 "rows_deleted bigint, compacted boolean, n_remaining bigint")


def q_compact_preserves(spark, sf):
    store, spec, _ = _items(spark, sf, fresh=True)
    R.compact(store, spec)
    t = store.table(spec)
    return t.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.countDistinct("source_file").cast("bigint").alias("n_files"),
                 F.sum(F.col("source_line").cast("bigint")).alias("sum_lines"),
                 F.min("time").alias("min_time"), F.max("time").alias("max_time"))


#: Small enough that the months of `lineitem` take several files each.
COMPACT_FILE_BYTES = 4096


def _time_order(spark, sf, kind) -> DataFrame:
    store, spec, _ = D.build_source(spark, kind, sf, cache=False)
    R.compact(store, spec, file_bytes=COMPACT_FILE_BYTES)
    found = P.overlaps(store, spec).agg(F.sum("n_overlaps").alias("n_overlaps"), (F.max("n_files") > 1).alias("several_files"))
    t = store.table(spec).agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("min_time"), F.max("time").alias("max_time"))
    return t.join(found)


def q_compact_time_order(spark, sf):
    """After a compaction the files of a date follow each other in time."""
    return _time_order(spark, sf, "lineitem")


def q_compact_burst(spark, sf):
    """The same where every row has one timestamp: still several files, cut by file and line."""
    return _time_order(spark, sf, "burst")


def q_size_cap(spark, sf):
    """Retention by size under a cap of half the table: what is left are the newest rows, and the table fits or three passes ran."""
    store, spec, _ = _items(spark, sf, fresh=True)
    cap = store.size_bytes(spec.id) // 2
    res = R.apply_retention(store, spec, RETENTION_NOW, cap_bytes=cap)
    left = store.table(spec).agg(F.count(F.lit(1)).alias("n_left"), F.min("time").alias("oldest"))
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    newer = items.join(left).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_shipdate") >= F.col("oldest")).alias("n_newer"))
    return left.join(newer).select(
        "n_rows", (F.lit(res.rows_deleted) + F.col("n_left")).cast("bigint").alias("n_accounted"), (F.col("n_newer") == F.col("n_left")).alias("kept_are_newest"),
        F.lit(res.size_bytes <= cap or res.size_passes == R.SIZE_CAP_MAX_PASSES).alias("fits"), F.lit(res.rows_deleted > 0).alias("deleted_some"))


def q_byte_order_marks(spark, sf):
    """Every second object starts with a byte-order mark: its first line is no JSON object and is skipped."""
    store, spec, _ = D.build_source(spark, "marked", sf, load=False, cache=False)
    return _summaries(spark, L.sync(store, spec))


def q_autoload_batches(spark, sf):
    """The stream with at most twenty files a batch: every file once, and as many batches as that takes."""
    from tidelog.streaming.autoload import done_batches, start_autoload
    store, spec, _ = D.build_source(spark, "orders", sf, load=False, cache=False)
    ckpt = f"{store.root}/autoload"
    start_autoload(store, spec.id, ckpt, available_now=True, max_files=20).awaitTermination()
    return (store.table(spec).groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("n_batches", F.lit(len(done_batches(store, ckpt))).cast("bigint")))


def q_trim_fraction(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    sizes = o.groupBy("o_orderpriority").agg((F.count(F.lit(1)) * 4096).cast("bigint").alias("size_bytes"))
    cap = F.lit(1024 * 1024).cast("bigint")
    return sizes.select("o_orderpriority", "size_bytes", S.trim_fraction_col(F.col("size_bytes"), cap).alias("fraction"))


MANIFEST_T1 = datetime(2024, 1, 1, 0, 0, 0)
MANIFEST_T2 = datetime(2024, 1, 2, 0, 0, 0)


def q_manifest_upsert(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    per = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
    t1 = F.lit(MANIFEST_T1.isoformat(sep=" ")).cast("timestamp_ntz")
    t2 = F.lit(MANIFEST_T2.isoformat(sep=" ")).cast("timestamp_ntz")
    v1 = per.select(F.lit("orders").alias("source_id"), "file_name", t1.alias("ingested_at"),
                    F.col("n").cast("int").alias("rows_ingested"))
    odd = F.substring("file_name", 6, 2).cast("int") % 2 == 1
    v2 = per.where(odd).select(F.lit("orders").alias("source_id"), "file_name", t2.alias("ingested_at"),
                               (F.col("n") + 1).cast("int").alias("rows_ingested"))
    return upsert_latest(v1.unionByName(v2))


def _odd_month() -> Column:
    return F.substring(F.col("name"), 13, 2).cast("int") % 2 == 1


def q_new_files(spark, sf):
    store, spec, _ = D.build_source(spark, "orders", sf, names_filter=_odd_month())
    return L.pending_files(store, spec).select("name")


def q_listing_loaded_flag(spark, sf):
    store, spec, _ = D.build_source(spark, "orders", sf, names_filter=_odd_month())
    return L.listing_with_flag(store, spec).select("name", "loaded")


def q_load_list_summary(spark, sf):
    store, spec, _ = D.build_source(spark, "orders", sf, names_filter=_odd_month(), cache=False)
    names = sorted(r["name"] for r in L.listing_with_flag(store, spec).select("name").collect())
    even = [n for n in names if int(n[12:14]) % 2 == 0][:2]
    odd = [n for n in names if int(n[12:14]) % 2 == 1][:1]
    ask = [even[0], odd[0], "orders/missing.ndjson"] + even[1:]
    res = L.load_files(store, spec, ask)
    rows = [(i, s.file_name, s.rows_inserted, s.lines_skipped, s.already_loaded, bool(s.error))
            for i, s in enumerate(res)]
    return spark.createDataFrame(rows, "pos int, file_name string, rows_inserted bigint, lines_skipped bigint, "
                                       "already_loaded boolean, has_error boolean")


def q_reload_idempotent(spark, sf):
    store, spec, _ = D.build_source(spark, "orders", sf, cache=False)
    L.sync_source(store, spec)
    return (store.table(spec).groupBy(F.col("source_file").alias("name"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))


def q_schema_evolution(spark, sf):
    half = (spark.read.parquet(f"{sf}/events.parquet").agg(F.max("event_id")).collect()[0][0] // 1000 + 1) // 2
    first = F.substring(F.col("name"), 10, 5).cast("int") < half
    store, spec, _ = D.build_source(spark, "events", sf, names_filter=first, cache=False)
    store.update_source(spec.id, fields=list(spec.fields) + [Field("kind", ("kind",))])
    L.sync_source(store, spec.id)
    return store.table(spec.id).select("source_file", "source_line", "kind")


DUE_NOW = datetime(2024, 6, 1, 12, 0, 0)


def q_due_sources(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    now = F.lit(DUE_NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    src = c.select(
        "c_custkey", (F.col("c_custkey") % 3 == 0).alias("auto_load"),
        (F.col("c_nationkey") % 4).cast("int").alias("retention_days"), F.lit(0).alias("max_size_mb"),
        (F.lit(15) * (F.col("c_custkey") % 4 + 1)).cast("int").alias("poll_minutes"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.timestamp_add("MINUTE", -(F.col("c_custkey") % 120), now)).alias("last_polled_at"))
    return src.where(due_predicate(DUE_NOW)).select("c_custkey")


def q_migrate_legacy(spark, sf):
    """Shared legacy table (two sources in one, plus an obsolete file_hash column) built from the
    events source, split into per-source tables (O-45)."""
    store, spec, t = _events(spark, sf)
    legacy = t.drop("event_date").select(
        F.when(F.col("source_line") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("source_id"), "*",
        F.xxhash64("raw").cast("string").alias("file_hash"))
    man = store.manifest(spec.id).select(F.lit("even").alias("source_id"), "file_name", "ingested_at",
                                         "rows_ingested")
    area = D.new_area(spark, "legacy")
    target = LogStore(spark, f"{area}/store")
    for sid in ("even", "odd"):
        target.create_source(sid, "path", {"root": f"{area}/none"})
    R.migrate_legacy(target, legacy, man)
    parts = [target.table(sid).select(F.lit(sid).alias("source_id"), "source_file", "source_line", "level")
             for sid in ("even", "odd")]
    return parts[0].unionByName(parts[1])


def q_reencode(spark, sf):
    """Partitions written with another codec are rewritten as ZSTD; rows are unchanged (O-44)."""
    store, spec, _ = D.build_source(spark, "events", sf, cache=False)
    parts = list(P.partitions(store, spec.id))
    staged = f"{store.table_dir(spec.id)}/rewrite/legacy"
    (store.table(spec).write.mode("overwrite").partitionBy("event_date").option("compression", "snappy")
     .parquet(staged))
    P.swap(store, spec, staged, parts)
    before = len(R.legacy_partitions(store, spec.id))
    R.reencode(store, spec)
    left = len(R.legacy_partitions(store, spec.id))
    return (store.table(spec).select("source_file", "source_line", "level")
            .withColumn("legacy_before", F.lit(min(before, 1)).cast("bigint"))
            .withColumn("legacy_left", F.lit(left).cast("bigint")))


def q_autoload_stream(spark, sf):
    from tidelog.streaming.autoload import start_autoload
    store, spec, _ = D.build_source(spark, "orders", sf, load=False, cache=False)
    q = start_autoload(store, spec.id, available_now=True)
    q.awaitTermination()
    return (store.table(spec).groupBy(F.col("source_file").alias("name"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))


def q_reload_replaces(spark, sf):
    """Every second file's marker goes; the next load replaces the rows of those files."""
    from tidelog.catalog import forget_files
    store, spec, _ = D.build_source(spark, "orders", sf, cache=False)
    names = sorted(r["file_name"] for r in store.manifest(spec.id).select("file_name").collect())
    forget_files(store, spec.id, names[::2])
    L.sync_source(store, spec)
    return (store.table(spec).groupBy(F.col("source_file").alias("name"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))


def _summaries(spark, done) -> DataFrame:
    rows = [(s.file_name, s.rows_inserted, s.lines_skipped, bool(s.error)) for s in done]
    return spark.createDataFrame(rows, "file_name string, rows_inserted bigint, lines_skipped bigint, has_error boolean")


def q_load_summary_counts(spark, sf):
    """Inserted and skipped lines of every file as the loader itself reports them."""
    store, spec, _ = D.build_source(spark, "events", sf, load=False, cache=False)
    return _summaries(spark, L.sync_summaries(store, spec))


def q_odd_object_names(spark, sf):
    """Objects whose names hold spaces, plus and percent signs and pattern characters: rows under their own names."""
    store, spec, _ = D.build_source(spark, "odd_names", sf, load=False, cache=False)
    done = _summaries(spark, L.sync_summaries(store, spec))
    held = store.table(spec).groupBy(F.col("source_file").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return done.join(held, "file_name", "left")


def q_long_line_rejected(spark, sf):
    """The first object holds one line of over 10 MiB: that file is an error, without rows or marker."""
    store, spec, _ = D.build_source(spark, "long_line", sf, load=False, cache=False)
    done = _summaries(spark, L.sync_summaries(store, spec)).select("file_name", "has_error")
    held = store.table(spec).groupBy(F.col("source_file").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    marked = store.manifest(spec.id).select("file_name", F.lit(True).alias("m"))
    return (done.join(held, "file_name", "left").join(marked, "file_name", "left")
            .select("file_name", "has_error", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("m").isNotNull().alias("marked")))


def q_autoload_with_bad_file(spark, sf):
    """The same objects by the stream: the bad one is recorded, the others arrive."""
    from tidelog.streaming.autoload import failed_files, start_autoload
    store, spec, _ = D.build_source(spark, "long_line", sf, load=False, cache=False)
    start_autoload(store, spec.id, available_now=True).awaitTermination()
    held = store.table(spec).groupBy(F.col("source_file").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    bad = spark.createDataFrame([(n, 0) for n in failed_files(store, spec.id)], "file_name string, n_rows bigint")
    return held.unionByName(bad)


def q_epoch_bounds(spark, sf):
    """Seconds, milliseconds, and numbers that no timestamp can hold: those give no time and cost no other line."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    c = F.col("event_id") % 5
    num = (F.when(c == 0, F.floor(us / 1000000)).when(c == 1, F.floor(us / 1000)).when(c == 2, us * 1000)
           .when(c == 3, F.lit(9300000000000000)).otherwise(F.lit(100000000000)).cast("bigint"))
    lines = ev.select("event_id", F.concat(F.lit('{"time":'), num.cast("string"), F.lit("}")).alias("raw"))
    return N.parse_lines_df(lines, [Field("time", ("time",), True)]).select("event_id", "time")


def q_age_filter(spark, sf):
    """Objects no older than the age limit, at three clock times: now, within the limit, beyond it."""
    store, spec, _ = D.build_source(spark, "orders", sf, load=False, cache=False)
    spec.load_days_back = 3
    now = L.utc_now()
    rows = [(d, L.pending_files(store, spec, now + timedelta(days=d)).count()) for d in (0, 2, 10)]
    return spark.createDataFrame(rows, "days_later int, n_files bigint")


def _priority_sources(spark, sf) -> LogStore:
    """A catalogue with one loaded source for each of the five order priorities."""
    area = D.new_area(spark, "priorities")
    D.write_ndjson(spark, D.priority_lines(spark.read.parquet(f"{sf}/orders.parquet")), f"{area}/objects")
    store = LogStore(spark, f"{area}/store")
    for name in PRIORITIES:
        spec = store.create_source(name, "path", {"root": f"{area}/objects"}, prefix=f"p{name[0]}/", retention_days=int(name[0]), partition_unit="month")
        L.sync_source(store, spec)
    return store


def _rows_of(store: LogStore) -> DataFrame:
    """Rows and columns of every source of a catalogue."""
    counts = [store.table(s).groupBy(F.lit(s.name).alias("name")).agg(F.count(F.lit(1)).alias("n_rows")) for s in store.list_sources()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def q_define_source(spark, sf):
    """Definitions as they are read back from the catalogue, with the rows that their typed tables took."""
    store = _priority_sources(spark, sf)
    defined = store.sources_df().select("name", "prefix", "retention_days", F.json_array_length("fields_json").alias("n_fields"))
    return defined.join(_rows_of(store), "name")


def q_sources_report(spark, sf):
    """The report's sizes against those that the rows' own files have."""
    store = _priority_sources(spark, sf)
    files = None
    for s in store.list_sources():
        one = store.table(s).select(F.lit(s.name).alias("name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        files = one if files is None else files.unionByName(one)
    own = files.groupBy("name", "file").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n")).groupBy("name").agg(
        F.sum("size").alias("own_bytes"), F.sum("n").alias("n_rows"))
    return store.sources_df().join(own, "name").select("name", "source_type", "prefix", "retention_days", "n_rows",
                                                       ((F.col("size_bytes") == F.col("own_bytes")) & (F.col("size_bytes") > 0)).alias("size_agrees"))


def q_partition_sizes(spark, sf):
    """Bytes of every partition by the distributed listing, against the sizes that the rows' own files report."""
    store, spec, t = _events(spark, sf)
    files = t.groupBy("event_date", F.col("_metadata.file_path").alias("file")).agg(F.first("_metadata.file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    own = files.groupBy("event_date").agg(F.sum("size").alias("own_bytes"), F.sum("n").alias("n_rows"))
    listed = store.sizes_df().where(F.col("id") == spec.id)
    both = own.join(listed, own["event_date"].eqNullSafe(listed["event_date"]), "full")
    same = (F.col("own_bytes") == F.col("size_bytes")) & (F.col("size_bytes") > 0)
    return both.agg(F.sum("n_rows").alias("n_rows"), F.min(F.coalesce(same, F.lit(False))).alias("sizes_agree"))


def q_drop_source(spark, sf):
    """One source of the catalogue is dropped; the others keep their rows, and its own table can't be read any more."""
    store = _priority_sources(spark, sf)
    gone = store.list_sources()[0]
    store.delete_source(gone.id)
    left = _rows_of(store).withColumn("readable", F.lit(True))
    try:
        store.table(gone)
        dropped = True
    except KeyError:
        dropped = D.fs.exists(spark, store.table_dir(gone.id))
    return left.unionByName(spark.createDataFrame([(gone.name, 0, dropped)], "name string, n_rows bigint, readable boolean"))


def q_maintenance_pass(spark, sf):
    """One pass over a source with auto-load and age expiry: what it reports and what is left."""
    from tidelog.plans.maintenance import run_maintenance
    store, spec, _ = D.build_source(spark, "orders", sf, load=False, cache=False)
    spec.auto_load, spec.retention_days = True, RETENTION_DAYS
    store.save(spec)
    rep = run_maintenance(store, RETENTION_NOW)[0]
    t = store.table(spec)
    return t.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("min_time")).select(
        "*", F.lit(rep.files_loaded).cast("bigint").alias("files_loaded"), F.lit(rep.retention.rows_deleted).cast("bigint").alias("n_deleted"),
        F.lit(len(rep.errors)).cast("bigint").alias("n_errors"))


# --- oracle SQL (DuckDB) -----------------------------------------------------------------------
def _page_sql(lo: str, hi: str) -> str:
    """Rows ranked lo < rn <= hi in page order (lo/hi are SQL expressions over nn = timed rows)."""
    return _ev(
        ", ranked AS (SELECT *, row_number() OVER (ORDER BY " + PAGE_ORDER_SQL + ") AS rn, "
        "count(time) OVER () AS nn FROM rows) "
        "SELECT time, level, " + FIELDS_TEXT_SQL + ", source_file, source_line FROM ranked "
        "WHERE rn > " + lo + " AND rn <= " + hi)


_ORDERS_NAMES = r"""
o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
shards AS (SELECT GREATEST(1, CAST(ceil(count(*) / (count(DISTINCT month) * 2000.0)) AS BIGINT)) AS s FROM o),
named AS (SELECT o.*, 'orders/' || month || '/part-' || CAST(o_orderkey % shards.s AS VARCHAR) || '.ndjson' AS name,
          CAST(substr(month, 6, 2) AS INTEGER) % 2 = 1 AS odd FROM o, shards)
"""

_ITEMS_CUTOFF = r"""
WITH t AS (SELECT l_shipdate AS t, row_number() OVER (ORDER BY l_shipdate) - 1 AS rn, count(*) OVER () AS n
           FROM lineitem),
f AS (SELECT CAST(x AS DOUBLE) AS fraction FROM (VALUES (0.1), (0.33), (0.5)) v(x))
SELECT f.fraction, min(t.t) + INTERVAL 1 MICROSECOND AS cutoff FROM f, t
WHERE t.rn = LEAST(GREATEST(CAST(floor(t.n * f.fraction) AS BIGINT), 1), t.n - 1)
GROUP BY f.fraction
"""

ORACLE = {
    "extract_fields": _ev("SELECT source_file, source_line, time, level, msg, topic, accession, study_uid FROM rows"),
    "line_numbers": _ev("SELECT source_file, source_line, raw FROM rows"),
    "load_counts": _ev(
        "SELECT source_file, CAST(SUM(CASE WHEN c NOT IN (4, 5) THEN 1 ELSE 0 END) AS INTEGER) AS rows_ingested, "
        "CAST(SUM(CASE WHEN c = 4 THEN 1 ELSE 0 END) AS BIGINT) AS lines_skipped, "
        "CAST(SUM(CASE WHEN c = 5 THEN 1 ELSE 0 END) AS BIGINT) AS blank_lines FROM lines GROUP BY source_file"),
    "crlf_lines": _ev(
        "SELECT source_file, CAST(SUM(CASE WHEN c = 1 AND alt = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_crlf, "
        "CAST(0 AS BIGINT) AS n_cr_in_table FROM lines GROUP BY source_file"),
    "wall_clock_time": _ev("SELECT source_file, source_line, time FROM rows WHERE c IN (0, 1, 6, 8) OR (c = 9 AND alt = 1)"),
    "epoch_time": _ev("SELECT source_file, source_line, time FROM rows WHERE c IN (2, 3, 7)"),
    "time_range": _ev("SELECT source_file, source_line, time FROM rows WHERE time >= TIMESTAMP '2024-01-05 00:00:00' "
                      "AND time <= TIMESTAMP '2024-01-12 12:00:00'"),
    "level_equals": _ev("SELECT source_file, source_line, level FROM rows WHERE level = 'ERROR'"),
    "field_contains": _ev("SELECT source_file, source_line FROM rows WHERE contains(msg, '0%') AND contains(topic, 'svc-')"),
    "field_underscore": _ev("SELECT source_file, source_line FROM rows WHERE contains(msg, 'r_1')"),
    "free_text": _ev("SELECT source_file, source_line FROM rows WHERE contains(raw, 'S1')"),
    "document_text": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE contains(text, 'the ')",
    "unknown_field_ignored": _ev("SELECT source_file, source_line FROM rows WHERE level = 'WARN'"),
    "newest_page": _page_sql("0", "101"),
    "second_page": _page_sql("100", "201"),
    "deep_page": _page_sql("GREATEST(0, nn - 50)", "GREATEST(0, nn - 50) + 101"),
    "keyset_page": _page_sql("GREATEST(0, nn - 50)", "GREATEST(0, nn - 50) + 101"),
    "end_of_day_bound": _ev("SELECT source_file, source_line, time FROM rows WHERE time >= TIMESTAMP '2024-01-03 00:00:00' "
                            "AND time <= TIMESTAMP '2024-01-03 23:59:59'"),
    "fields_map": _ev("SELECT source_file, source_line, " + FIELDS_TEXT_SQL + " FROM rows"),
    "detail_kv": _ev(
        ", kv AS (SELECT source_file, source_line, raw, unnest(json_keys(raw)) AS key FROM rows WHERE raw <> 'null') "
        "SELECT source_file, source_line, key, CASE WHEN json_type(raw, '$.\"' || key || '\"') = 'VARCHAR' "
        "THEN json_extract_string(raw, '$.\"' || key || '\"') "
        "ELSE CAST(json_extract(raw, '$.\"' || key || '\"') AS VARCHAR) END AS value FROM kv"),
    "clicked_value": _ev(
        ", v AS (SELECT accession FROM rows WHERE level = 'ERROR' AND accession IS NOT NULL ORDER BY "
        + PAGE_ORDER_SQL + " LIMIT 1) SELECT source_file, source_line FROM rows WHERE contains(raw, (SELECT accession FROM v))"),
    "distinct_levels": _ev("SELECT DISTINCT level FROM rows WHERE level IS NOT NULL"),
    "severity_bucket": _ev(
        ", b AS (SELECT CASE WHEN upper(coalesce(level, '')) IN ('ERROR', 'FATAL', 'CRITICAL') THEN 'error' "
        "WHEN upper(coalesce(level, '')) IN ('WARN', 'WARNING') THEN 'warn' WHEN upper(coalesce(level, '')) = 'INFO' "
        "THEN 'info' WHEN upper(coalesce(level, '')) IN ('DEBUG', 'TRACE') THEN 'debug' ELSE 'other' END AS severity "
        "FROM rows) SELECT severity, CAST(count(*) AS BIGINT) AS n_rows FROM b GROUP BY severity"),
    "raw_line": _ev("SELECT source_file, source_line, raw FROM rows WHERE source_line = 1"),
    "row_count": _ev("SELECT CAST(count(*) AS BIGINT) AS n_rows FROM rows"),
    "time_bounds": _ev("SELECT min(time) AS min_time, max(time) AS max_time, CAST(count(*) AS BIGINT) AS n_rows FROM rows"),
    "range_counts": "SELECT CAST(l_shipdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY 1",
    "oldest_cutoff": _ITEMS_CUTOFF,
    "delete_older": (
        "SELECT l_returnflag AS level, CAST(count(*) AS BIGINT) AS n_rows, min(l_shipdate) AS min_time, "
        "(SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17 12:00:00') AS n_deleted "
        "FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17 12:00:00' GROUP BY l_returnflag"),
    "retention_policy": (
        "WITH c AS (SELECT CAST(SUM(CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 1000 DAY "
        "THEN 1 ELSE 0 END) AS BIGINT) AS d, CAST(SUM(CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01 00:00:00' "
        "- INTERVAL 1000 DAY THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem) "
        "SELECT d AS rows_deleted, (d > 0 AND (r = 0 OR d >= 0.25 * r)) AS compacted, r AS n_remaining FROM c"),
    "compact_preserves": (
        "WITH n AS (SELECT l_orderkey % (SELECT GREATEST(8, CAST(ceil(count(*) / 200000.0) AS BIGINT)) FROM lineitem) AS f, count(*) AS k FROM lineitem GROUP BY 1) "
        "SELECT (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS n_rows, CAST(count(*) AS BIGINT) AS n_files, "
        "CAST(SUM(k * (k + 1) / 2) AS BIGINT) AS sum_lines, (SELECT min(l_shipdate) FROM lineitem) AS min_time, "
        "(SELECT max(l_shipdate) FROM lineitem) AS max_time FROM n"),
    "trim_fraction": (
        "WITH s AS (SELECT o_orderpriority, CAST(count(*) * 4096 AS BIGINT) AS size_bytes FROM orders GROUP BY 1) "
        "SELECT o_orderpriority, size_bytes, LEAST(GREATEST((1.0 - CAST(1048576 AS BIGINT) / size_bytes) * 1.1, 0.1), 0.5) "
        "AS fraction FROM s"),
    "manifest_upsert": (
        "WITH per AS (SELECT strftime(o_orderdate, '%Y-%m') AS file_name, count(*) AS n FROM orders GROUP BY 1) "
        "SELECT 'orders' AS source_id, file_name, CASE WHEN CAST(substr(file_name, 6, 2) AS INTEGER) % 2 = 1 "
        "THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS ingested_at, "
        "CAST(CASE WHEN CAST(substr(file_name, 6, 2) AS INTEGER) % 2 = 1 THEN n + 1 ELSE n END AS INTEGER) "
        "AS rows_ingested FROM per"),
    "new_files": "WITH " + _ORDERS_NAMES + "SELECT DISTINCT name FROM named WHERE NOT odd",
    "listing_loaded_flag": "WITH " + _ORDERS_NAMES + "SELECT DISTINCT name, odd AS loaded FROM named",
    "load_list_summary": (
        "WITH " + _ORDERS_NAMES + ", files AS (SELECT name, odd, count(*) AS n FROM named GROUP BY name, odd), "
        "ev AS (SELECT name, n, row_number() OVER (ORDER BY name) AS r FROM files WHERE NOT odd), "
        "od AS (SELECT name, row_number() OVER (ORDER BY name) AS r FROM files WHERE odd), "
        "ask AS (SELECT 0 AS pos, name, n, false AS al, false AS er FROM ev WHERE r = 1 "
        "UNION ALL SELECT 1, name, 0, true, false FROM od WHERE r = 1 "
        "UNION ALL SELECT 2, 'orders/missing.ndjson', 0, false, true "
        "UNION ALL SELECT 3, name, n, false, false FROM ev WHERE r = 2) "
        "SELECT CAST(pos AS INTEGER) AS pos, name AS file_name, CAST(n AS BIGINT) AS rows_inserted, "
        "CAST(0 AS BIGINT) AS lines_skipped, al AS already_loaded, er AS has_error FROM ask"),
    "reload_idempotent": "WITH " + _ORDERS_NAMES + "SELECT name, CAST(count(*) AS BIGINT) AS n_rows FROM named GROUP BY name",
    "schema_evolution": _ev(
        ", h AS (SELECT (max(event_id) // 1000 + 1) // 2 AS half FROM events) "
        "SELECT source_file, source_line, CASE WHEN c IN (0, 2) AND id // 1000 >= h.half THEN event_type END AS kind "
        "FROM rows, h"),
    "due_sources": (
        "SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0 OR c_nationkey % 4 > 0) AND "
        "(c_custkey % 7 = 0 OR (c_custkey % 120) * 60 >= 15 * (c_custkey % 4 + 1) * 60)"),
    "migrate_legacy": _ev("SELECT CASE WHEN source_line % 2 = 0 THEN 'even' ELSE 'odd' END AS source_id, "
                          "source_file, source_line, level FROM rows"),
    "reencode": _ev("SELECT source_file, source_line, level, CAST(1 AS BIGINT) AS legacy_before, "
                    "CAST(0 AS BIGINT) AS legacy_left FROM rows"),
    "autoload_stream": "WITH " + _ORDERS_NAMES + "SELECT name, CAST(count(*) AS BIGINT) AS n_rows FROM named GROUP BY name",
    "reload_replaces": "WITH " + _ORDERS_NAMES + "SELECT name, CAST(count(*) AS BIGINT) AS n_rows FROM named GROUP BY name",
    "combined_search": _ev(
        ", hits AS (SELECT time, level, source_file, source_line, row_number() OVER (ORDER BY " + PAGE_ORDER_SQL + ") AS rn, "
        "count(*) OVER () > 100 AS has_more FROM rows WHERE time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28' "
        "AND level = 'ERROR' AND contains(msg, 'user_') AND contains(raw, 'error')) "
        "SELECT time, level, source_file, source_line, has_more FROM hits WHERE rn <= 100"),
    "original_lines": _ev("SELECT source_file, source_line, raw FROM rows ORDER BY " + PAGE_ORDER_SQL + " LIMIT 3"),
    "load_summary_counts": _ev(
        "SELECT source_file AS file_name, CAST(count(*) FILTER (c NOT IN (4, 5)) AS BIGINT) AS rows_inserted, "
        "CAST(count(*) FILTER (c = 4) AS BIGINT) AS lines_skipped, false AS has_error FROM lines GROUP BY source_file"),
    "odd_object_names": _ev(
        "SELECT replace(source_file, 'app-', 'a b+c%20[x]{y}-') AS file_name, CAST(count(*) FILTER (c NOT IN (4, 5)) AS BIGINT) AS rows_inserted, "
        "CAST(count(*) FILTER (c = 4) AS BIGINT) AS lines_skipped, false AS has_error, "
        "CAST(count(*) FILTER (c NOT IN (4, 5)) AS BIGINT) AS n_rows FROM lines GROUP BY source_file"),
    "long_line_rejected": _ev(
        "SELECT source_file AS file_name, source_file = 'logs/app-00000.ndjson' AS has_error, "
        "CAST(count(*) FILTER (c NOT IN (4, 5) AND source_file <> 'logs/app-00000.ndjson') AS BIGINT) AS n_rows, "
        "source_file <> 'logs/app-00000.ndjson' AS marked FROM lines GROUP BY source_file"),
    "autoload_with_bad_file": _ev(
        "SELECT source_file AS file_name, CAST(count(*) FILTER (c NOT IN (4, 5) AND source_file <> 'logs/app-00000.ndjson') AS BIGINT) "
        "AS n_rows FROM lines GROUP BY source_file"),
    "epoch_bounds": (
        "SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) "
        "WHEN 4 THEN make_timestamp(100000000000 * 1000000) END AS time FROM events"),
    "age_filter": (
        "WITH " + _ORDERS_NAMES + ", f AS (SELECT count(DISTINCT name) AS n FROM named) "
        "SELECT CAST(d AS INTEGER) AS days_later, CAST(CASE WHEN d <= 3 THEN n ELSE 0 END AS BIGINT) AS n_files "
        "FROM f, (VALUES (0), (2), (10)) v(d)"),
    "define_source": (
        "SELECT o_orderpriority AS name, 'p' || o_orderpriority[1] || '/' AS prefix, CAST(o_orderpriority[1] AS INTEGER) AS retention_days, "
        "CAST(6 AS INTEGER) AS n_fields, CAST(count(*) AS BIGINT) AS n_rows FROM orders GROUP BY ALL"),
    "sources_report": (
        "SELECT o_orderpriority AS name, 'path' AS source_type, 'p' || o_orderpriority[1] || '/' AS prefix, "
        "CAST(o_orderpriority[1] AS INTEGER) AS retention_days, CAST(count(*) AS BIGINT) AS n_rows, true AS size_agrees FROM orders GROUP BY ALL"),
    "drop_source": (
        "SELECT o_orderpriority AS name, CAST(count(*) FILTER (o_orderpriority <> '1-URGENT') AS BIGINT) AS n_rows, "
        "o_orderpriority <> '1-URGENT' AS readable FROM orders GROUP BY o_orderpriority"),
    "partition_sizes": _ev("SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS sizes_agree FROM rows"),
    "rare_needle_page": _ev(
        ", hits AS (SELECT *, row_number() OVER (ORDER BY " + PAGE_ORDER_SQL + ") AS rn FROM rows WHERE contains(raw, ' #77')) "
        "SELECT time, level, " + FIELDS_TEXT_SQL + ", source_file, source_line, CAST(1 AS BIGINT) AS reads_of_a_file FROM hits WHERE rn <= 100"),
    "pick_list": _ev(
        ", v AS (SELECT DISTINCT accession FROM rows WHERE accession IS NOT NULL) "
        "SELECT source_file, source_line FROM rows WHERE EXISTS (SELECT 1 FROM v WHERE contains(raw, v.accession))"),
    "pick_list_matches": _ev(
        ", v AS (SELECT DISTINCT CASE event_id % 50 WHEN 0 THEN 'user_' || user_id || ' #' || event_id WHEN 1 THEN event_type WHEN 2 THEN 'S' || user_id "
        "WHEN 4 THEN 'no such' END AS value FROM events) "
        "SELECT value, CAST(count(*) AS BIGINT) AS n_rows FROM rows JOIN v ON contains(raw, value) GROUP BY value"),
    "look_up_lines": _ev("SELECT source_file, source_line, raw FROM rows WHERE id % 37 = 0"),
    "text_skipping": ("SELECT l_shipdate AS time, true AS files_skipped FROM lineitem "
                      "WHERE contains('order ' || l_orderkey || ' line ' || l_linenumber, 'order 7 line 1')"),
    "compact_time_order": ("SELECT CAST(count(*) AS BIGINT) AS n_rows, min(l_shipdate) AS min_time, max(l_shipdate) AS max_time, CAST(0 AS BIGINT) AS n_overlaps, "
                           "true AS several_files FROM lineitem"),
    "compact_burst": ("SELECT CAST(count(*) AS BIGINT) AS n_rows, TIMESTAMP '1995-06-17' AS min_time, TIMESTAMP '1995-06-17' AS max_time, CAST(0 AS BIGINT) AS n_overlaps, "
                      "true AS several_files FROM lineitem"),
    "size_cap": ("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_accounted, true AS kept_are_newest, true AS fits, true AS deleted_some FROM lineitem"),
    "byte_order_marks": _ev(
        ", m AS (SELECT *, id % 1000 = 0 AND (id // 1000) % 2 = 0 AS marked FROM lines) "
        "SELECT source_file AS file_name, CAST(count(*) FILTER (c NOT IN (4, 5) AND NOT marked) AS BIGINT) AS rows_inserted, "
        "CAST(count(*) FILTER (c = 4 OR marked) AS BIGINT) AS lines_skipped, false AS has_error FROM m GROUP BY source_file"),
    "autoload_batches": ("WITH " + _ORDERS_NAMES + "SELECT name, CAST(count(*) AS BIGINT) AS n_rows, "
                         "CAST(ceil((SELECT count(DISTINCT name) FROM named) / 20.0) AS BIGINT) AS n_batches FROM named GROUP BY name"),
    "maintenance_pass": (
        "WITH " + _ORDERS_NAMES + f", cut AS (SELECT TIMESTAMP '{RETENTION_NOW.isoformat(sep=' ')}' - INTERVAL {RETENTION_DAYS} DAY AS t), "
        "n AS (SELECT count(DISTINCT name) AS f, count(*) FILTER (CAST(o_orderdate AS TIMESTAMP) < t) AS d FROM named, cut) "
        "SELECT o_orderstatus AS level, CAST(count(*) AS BIGINT) AS n_rows, min(CAST(o_orderdate AS TIMESTAMP)) AS min_time, "
        "CAST(any_value(f) AS BIGINT) AS files_loaded, CAST(any_value(d) AS BIGINT) AS n_deleted, CAST(0 AS BIGINT) AS n_errors "
        "FROM named, cut, n WHERE CAST(o_orderdate AS TIMESTAMP) >= t GROUP BY o_orderstatus"),
}

QUERIES = {
    "extract_fields": q_extract_fields,
    "line_numbers": q_line_numbers,
    "load_counts": q_load_counts,
    "crlf_lines": q_crlf_lines,
    "wall_clock_time": q_wall_clock_time,
    "epoch_time": q_epoch_time,
    "time_range": q_time_range,
    "level_equals": q_level_equals,
    "field_contains": q_field_contains,
    "field_underscore": q_field_underscore,
    "free_text": q_free_text,
    "document_text": q_document_text,
    "unknown_field_ignored": q_unknown_field_ignored,
    "newest_page": q_newest_page,
    "second_page": q_second_page,
    "deep_page": q_deep_page,
    "keyset_page": q_keyset_page,
    "end_of_day_bound": q_end_of_day_bound,
    "fields_map": q_fields_map,
    "detail_kv": q_detail_kv,
    "clicked_value": q_clicked_value,
    "distinct_levels": q_distinct_levels,
    "severity_bucket": q_severity_bucket,
    "raw_line": q_raw_line,
    "row_count": q_row_count,
    "time_bounds": q_time_bounds,
    "range_counts": q_range_counts,
    "oldest_cutoff": q_oldest_cutoff,
    "delete_older": q_delete_older,
    "retention_policy": q_retention_policy,
    "compact_preserves": q_compact_preserves,
    "trim_fraction": q_trim_fraction,
    "manifest_upsert": q_manifest_upsert,
    "new_files": q_new_files,
    "listing_loaded_flag": q_listing_loaded_flag,
    "load_list_summary": q_load_list_summary,
    "reload_idempotent": q_reload_idempotent,
    "schema_evolution": q_schema_evolution,
    "due_sources": q_due_sources,
    "migrate_legacy": q_migrate_legacy,
    "reencode": q_reencode,
    "autoload_stream": q_autoload_stream,
    "combined_search": q_combined_search,
    "original_lines": q_original_lines,
    "reload_replaces": q_reload_replaces,
    "load_summary_counts": q_load_summary_counts,
    "odd_object_names": q_odd_object_names,
    "long_line_rejected": q_long_line_rejected,
    "autoload_with_bad_file": q_autoload_with_bad_file,
    "epoch_bounds": q_epoch_bounds,
    "age_filter": q_age_filter,
    "define_source": q_define_source,
    "sources_report": q_sources_report,
    "drop_source": q_drop_source,
    "maintenance_pass": q_maintenance_pass,
    "partition_sizes": q_partition_sizes,
    "rare_needle_page": q_rare_needle_page,
    "pick_list": q_pick_list,
    "pick_list_matches": q_pick_list_matches,
    "look_up_lines": q_look_up_lines,
    "text_skipping": q_text_skipping,
    "compact_time_order": q_compact_time_order,
    "compact_burst": q_compact_burst,
    "size_cap": q_size_cap,
    "byte_order_marks": q_byte_order_marks,
    "autoload_batches": q_autoload_batches,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Newest 100 ERROR lines containing a needle inside a time range (the minimum slice)."""
    _, spec, t = _events(spark, sf)
    df = Q.filtered(t, spec, time_from=datetime(2024, 1, 2), time_to=datetime(2024, 1, 28, 23, 59, 59),
                    level="ERROR", text="user_")
    return _page_cols(Q.page(df, spec, 0))
