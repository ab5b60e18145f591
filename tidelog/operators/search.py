"""Search over a source table (O-8, O-18 ... O-29).

Predicates are plain Columns, so Catalyst pushes them into the Parquet scan; a time range also
adds `event_date` bounds so whole date partitions are pruned (rows of the NULL date partition
are kept for the row-level test, since their time can still match).  Pages are top-k plans
(`TakeOrderedAndProject`), never a full sort; only page rows reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import extract as X
from tidelog.operators import stats
from tidelog.spec import SourceSpec

# Fixed values that must match for identical behaviour.
PAGE_SIZE = 100
#: Rows before a page that its top-k may hold.
DEEP_OFFSET = 20_000
#: Values tested by one expression of a pick list; longer lists are cut into blocks of this size.
PICK_BLOCK = 1_000


def order() -> list[Column]:
    """Newest first, NULL time last, then file and line so pages are stable (T21)."""
    return [F.col("time").desc_nulls_last(), F.col("source_file").asc(), F.col("source_line").asc()]


def _ntz(ts: datetime) -> Column:
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def date_bounds(time_from: datetime | None, time_to: datetime | None, unit: str = "day") -> Column | None:
    """Partition-pruning form of a time range: event_date within the range's dates, or NULL."""
    preds = []
    if time_from is not None:
        preds.append(F.col("event_date") >= F.lit(X.unit_start(time_from.date(), unit)))
    if time_to is not None:
        preds.append(F.col("event_date") <= F.lit(X.unit_start(time_to.date(), unit)))
    if not preds:
        return None
    return X.all_of(preds) | F.col("event_date").isNull()


def predicates(spec: SourceSpec, time_from: datetime | None = None, time_to: datetime | None = None,
               level: str = "", fields: dict | None = None, text: str = "") -> list[Column]:
    """Filters AND-ed together (O-19 ... O-22).  Bounds are inclusive (T17); level is exact;
    field and text filters are literal, case-sensitive substrings (T19).  Unknown columns,
    time/level through the map and empty values are ignored (T20)."""
    out = []
    if time_from is not None:
        out.append(F.col("time") >= _ntz(time_from))
    if time_to is not None:
        out.append(F.col("time") <= _ntz(time_to))
    b = date_bounds(time_from, time_to, spec.partition_unit)
    if b is not None:
        out.append(b)
    if level:
        out.append(F.col("level") == F.lit(level))
    known = set(spec.other_columns)
    for col, val in sorted((fields or {}).items()):
        if val and col in known:
            out.append(F.col(col).contains(F.lit(val)))
    if text:
        out.append(F.col("raw").contains(F.lit(text)))
    return out


def filtered(table: DataFrame, spec: SourceSpec, **kw) -> DataFrame:
    p = X.all_of(predicates(spec, **kw))
    return table if p is None else table.where(p)


def result_columns(spec: SourceSpec) -> list[Column]:
    """Result row: time, level, fields map without NULLs (msg included), file, line (T29, O-24)."""
    return [F.col("time"), F.col("level"), X.fields_map(spec.other_columns).alias("fields"),
            F.col("source_file"), F.col("source_line")]


def _without_newer(df: DataFrame, spec: SourceSpec, offset: int) -> tuple[DataFrame, int]:
    """The rows that aren't newer than the one at `offset` in page order, and that row's offset among them.

    Its time is an order statistic, found from bucket counts (`stats`); the rows before it are only counted."""
    timed = df.where(F.col("time").isNotNull())
    n = timed.count()
    if offset >= n:
        return df.where(F.col("time").isNull()), offset - n
    at = stats.micros_lit(stats.kth_key_micros(timed, n - 1 - offset, unit=spec.partition_unit))
    newer = timed.where(F.col("time") > at).count()
    return df.where(F.col("time").isNull() | (F.col("time") <= at)), offset - newer


def page(df: DataFrame, spec: SourceSpec, offset: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Newest-first page plus one look-ahead row (O-23): offset < 0 counts as 0 (T22).

    A top-k holds all rows up to the page in its last task: beyond DEEP_OFFSET rows, those newer than the page are left out first."""
    offset = max(0, int(offset))
    if offset > DEEP_OFFSET:
        df, offset = _without_newer(df, spec, offset)
    q = df.orderBy(*order())
    if offset:
        q = q.offset(offset)
    return q.limit(size + 1).select(*result_columns(spec))


def newest_dates(dates: list[date], below: date | None = None) -> list[date]:
    """Partition dates newest first, those after `below` left out."""
    return sorted((d for d in dates if below is None or d <= below), reverse=True)


def newest_rows(df: DataFrame, dates: list[date | None], need: int, below: date | None = None) -> DataFrame:
    """The part of `df` that holds its `need` newest rows, whole date partitions at a time; the result is exact.

    A row with a time sits in the partition of its date, so partitions are taken newest first, twice as many each time,
    until they hold `need` rows with a time.  Times out of the partition range sit in the NULL partition, always read.  When
    all partitions together have too few, rows without a time count as well and nothing is left out.  Each probe stops
    at `need` rows."""
    days = newest_dates([d for d in dates if d is not None], below)
    k = 1
    while k < len(days):
        cut = F.col("event_date") >= F.lit(days[k - 1])
        if below is not None:
            cut = cut & (F.col("event_date") <= F.lit(below))
        timed = df.where(F.col("time").isNotNull())
        if timed.where(cut).select(F.lit(1)).limit(need).count() >= need:
            return timed.where(cut | F.col("event_date").isNull())
        k *= 2
    return df


def newest_page(df: DataFrame, spec: SourceSpec, dates: list[date | None], offset: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """`page` without reading partitions that can't reach it (O-23); `dates`: the table's partition dates."""
    offset = max(0, int(offset))
    return page(newest_rows(df, dates, offset + size + 1), spec, offset, size)


@dataclass
class SearchResult:
    rows: list
    has_more: bool


def search(table: DataFrame, spec: SourceSpec, time_from=None, time_to=None, level: str = "",
           fields: dict | None = None, text: str = "", offset: int = 0, size: int = PAGE_SIZE,
           dates: list[date | None] | None = None) -> SearchResult:
    """Combined search (O-28): at most size + 1 rows reach the driver.  With the table's partition dates, partitions
    too old for the page aren't read."""
    df = filtered(table, spec, time_from=time_from, time_to=time_to, level=level, fields=fields, text=text)
    found = page(df, spec, offset, size) if dates is None else newest_page(df, spec, dates, offset, size)
    rows = found.collect()
    return SearchResult(rows[:size], len(rows) > size)


def _tie_after(cursor_file: str, cursor_line: int) -> Column:
    return (F.col("source_file") > F.lit(cursor_file)) | (
        (F.col("source_file") == F.lit(cursor_file)) & (F.col("source_line") > F.lit(cursor_line)))


def keyset_page(df: DataFrame, spec: SourceSpec, cursor=None, size: int = PAGE_SIZE,
                dates: list[date | None] | None = None) -> DataFrame:
    """Next page after a cursor (time, file, line) = the last row of the previous page, in
    (time DESC NULLS LAST, file, line) order (O-25): cost does not grow with depth.

    Rows with a time older than the cursor sit in date partitions up to the cursor's date, so
    that branch is pruned; NULL-time rows sit in the partition of their load date, so they are a
    second top-k (Parquet null counts skip row groups without NULL time).  A final top-k merges
    the two bounded branches.  With the table's partition dates, partitions are taken from the cursor's date
    downwards until the page is full, and rows without a time are read only where it isn't."""
    def top(d: DataFrame) -> DataFrame:
        return d.orderBy(*order()).limit(size + 1)

    if cursor is None:
        return top(df if dates is None else newest_rows(df, dates, size + 1)).select(*result_columns(spec))
    ct_val, cf, cl = cursor
    if ct_val is None:
        return top(df.where(F.col("time").isNull() & _tie_after(cf, cl))).select(*result_columns(spec))
    ct = _ntz(ct_val)
    older = (F.col("time") < ct) | ((F.col("time") == ct) & _tie_after(cf, cl))
    prune = (F.col("event_date") <= F.lit(X.unit_start(ct_val.date(), spec.partition_unit))) | F.col("event_date").isNull()
    if dates is not None:
        rest = df.where(older)
        near = newest_rows(rest, dates, size + 1, X.unit_start(ct_val.date(), spec.partition_unit))
        if near is not rest:
            return top(near).select(*result_columns(spec))
    timed = top(df.where(older & prune))
    nulls = top(df.where(F.col("time").isNull()))
    return top(timed.unionByName(nulls)).select(*result_columns(spec))


def end_of_day_bound(day: date, hour: int | None = None, minute: int | None = None,
                     second: int | None = None, end_of_day: bool = False) -> datetime:
    """UI date boundary (T18): blank hour/minute/second default to 0, or 23/59/59 for 'to'."""
    h = hour if hour is not None else (23 if end_of_day else 0)
    m = minute if minute is not None else (59 if end_of_day else 0)
    s = second if second is not None else (59 if end_of_day else 0)
    return datetime.combine(day, time(0, 0, 0)) + timedelta(hours=h, minutes=m, seconds=s)


def raw_line(table: DataFrame, source_file: str, source_line: int) -> str:
    """Original line of one row (O-8); no such row is an error."""
    rows = (table.where((F.col("source_file") == F.lit(source_file)) & (F.col("source_line") == F.lit(source_line)))
            .select("raw").limit(1).collect())
    if not rows:
        raise KeyError((source_file, source_line))
    return rows[0]["raw"]


def distinct_levels(table: DataFrame) -> DataFrame:
    """Sorted distinct non-NULL levels (O-29); partial aggregation before the shuffle."""
    return table.where(F.col("level").isNotNull()).select("level").distinct().orderBy("level")


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", X.severity_bucket(F.col("level")))


def detail_kv(df: DataFrame) -> DataFrame:
    """Every top-level key/value of each row's original line (O-26): strings as-is, other values
    as JSON text.  Lines that are not an object (bare null) give no pairs."""
    v = F.try_parse_json(F.col("raw"))
    base = df.select("source_file", "source_line", v.alias("_v"))
    return base.select(
        "source_file", "source_line",
        F.explode(F.try_variant_get(F.col("_v"), "$", "map<string,variant>")).alias("key", "value")
    ).select(
        "source_file", "source_line", "key",
        F.when(F.schema_of_variant("value") == "STRING", F.variant_get("value", "$", "string"))
         .otherwise(F.to_json("value")).alias("value"))


def contains_any(values: list[str], col: str = "raw") -> Column:
    """Row text contains any value of a pick list of any length (O-27 as data), tested per row on the JVM in blocks."""
    vals = [v for v in dict.fromkeys(values) if v]
    out = F.lit(False)
    for k in range(0, len(vals), PICK_BLOCK):
        block = F.array(*[F.lit(v) for v in vals[k:k + PICK_BLOCK]])
        out = out | F.exists(block, lambda x: F.col(col).contains(x))
    return out
