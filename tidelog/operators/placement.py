"""Where rows lie: which data files hold rows of an object, and which times a data file spans.

Two small tables beside the data, appended before data files become visible:

    <table>/placement/   (source_file, event_date, data_file, times and counts)   one row per data file and object in it
    <table>/file_times/  (event_date, data_file, min_time, max_time, n_rows, n_untimed)   one row per data file

Data files are never changed and their names never used again, so a row of a data file that a rewrite replaced is merely dead:
readers look whether the file is still there.  Every visible data file has its rows; a table from before the two existed
gets them by one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.catalog import LogStore, local_frame
from tidelog.operators import ngrams
from tidelog.session import kept_columns
from tidelog.sources import fs
from tidelog.spec import SourceSpec

PLACEMENT = ("event_date date, data_file string, source_file string, min_time timestamp_ntz, max_time timestamp_ntz, "
             "n_rows bigint, n_untimed bigint")
TIMES = "event_date date, data_file string, min_time timestamp_ntz, max_time timestamp_ntz, n_rows bigint, n_untimed bigint"
NULL_PARTITION = "event_date=__HIVE_DEFAULT_PARTITION__"
#: Bloom filters as large as the names ask for; else each is 1 MB, however few these are.
BLOOM = {"parquet.bloom.filter.enabled#source_file": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Size of a written description up to which the driver sums its rows up.
LOCAL_BYTES = 1024 * 1024
#: Files of one of the two tables from which it is rewritten without its dead rows.
MANY_FILES = 64


def directory(event_date: date | None) -> str:
    return NULL_PARTITION if event_date is None else f"event_date={event_date.isoformat()}"


def _dir(store: LogStore, sid: str, name: str) -> str:
    return f"{store.table_dir(sid)}/{name}"


def describe(rows: DataFrame) -> DataFrame:
    """(event_date, data_file, source_file, counts and times) of rows as they lie in their files; two columns are read."""
    keys, sums = _describing()
    return rows.groupBy(*keys).agg(*sums)


@kept_columns
def _describing() -> tuple[list[Column], list[Column]]:
    return ([F.col("event_date"), F.col("_metadata.file_name").alias("data_file"), F.col("source_file")],
            [F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count(F.lit(1)).alias("n_rows"),
             F.count_if(F.col("time").isNull()).alias("n_untimed")])


def describe_staged(store: LogStore, spec: SourceSpec, staged: str) -> DataFrame | None:
    """`describe` of a staging folder, kept beside it so that the rows are read once; None where it holds no data file."""
    h = fs.Handle(store.spark, store.table_dir(spec.id))
    if not any(n.startswith("event_date=") for n in h.names(staged)):
        return None
    at = staged + ".files"
    if not h.exists(at + "/_SUCCESS"):
        _write(describe(store.spark.read.schema(spec.storage_schema()).parquet(staged)), at)
    return _description(store, at)


def _description(store: LogStore, at: str) -> DataFrame:
    """A written description; where it is one file, in one partition, whose sums take no shuffle."""
    found = store.spark.read.schema(PLACEMENT).parquet(at)
    return found.coalesce(1) if sum(n.startswith("part-") for n in fs.Handle(store.spark, at).names(at)) == 1 else found


def staged_counts(store: LogStore, spec: SourceSpec, staged: str) -> tuple[dict[str, int], pa.Table | None]:
    """Rows of every object in a staging folder; also its description, where that is small enough for the driver."""
    found = describe_staged(store, spec, staged)
    if found is None:
        return {}, None
    if sum(size for _, size in fs.Handle(store.spark, staged).sizes(staged + ".files")) > LOCAL_BYTES:
        return {r["source_file"]: r["n"] for r in found.groupBy("source_file").agg(F.sum("n_rows").alias("n")).collect()}, None
    rows = found.toArrow()
    per_file = rows.group_by("source_file").aggregate([("n_rows", "sum")])
    return dict(zip(per_file["source_file"].to_pylist(), per_file["n_rows_sum"].to_pylist())), rows


def _write(found: DataFrame, at: str) -> None:
    found.sortWithinPartitions("source_file").write.mode("overwrite").options(**BLOOM).parquet(at)


def record(store: LogStore, spec: SourceSpec, staged: str, described: pa.Table | None = None) -> None:
    """Add the rows of staged data files to both tables; to be called before the files are moved into the table.

    `described`: what their written description holds, where the driver has it (see `staged_counts`)."""
    ensure(store, spec)
    if described is not None or describe_staged(store, spec, staged) is not None:
        ngrams.append(store, spec, staged)
        _add(store, spec.id, staged + ".files", described)


def _add(store: LogStore, sid: str, at: str, described: pa.Table | None = None) -> None:
    """A written description joins the tables: its files move to `placement`, after `file_times` has its sums per data file."""
    if described is None:
        _times(_description(store, at)).write.mode("append").parquet(_dir(store, sid, "file_times"))
    else:
        sums = described.group_by(["event_date", "data_file"]).aggregate([("min_time", "min"), ("max_time", "max"), ("n_rows", "sum"), ("n_untimed", "sum")])
        fs.append_rows(store.spark, _dir(store, sid, "file_times"), sums.rename_columns([n.rsplit("_", 1)[0] if n.endswith(("_min", "_max", "_sum")) else n for n in sums.column_names]))
    h = fs.Handle(store.spark, at)
    h.mkdirs(_dir(store, sid, "placement"))
    for name in h.names(at):
        if name.startswith("part-"):
            h.rename(f"{at}/{name}", f"{_dir(store, sid, 'placement')}/{name}")
    h.delete(at, True)


def _times(found: DataFrame) -> DataFrame:
    return found.groupBy("event_date", "data_file").agg(*_time_sums())


@kept_columns
def _time_sums() -> list[Column]:
    return [F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.sum("n_rows").alias("n_rows"), F.sum("n_untimed").alias("n_untimed")]


def ensure(store: LogStore, spec: SourceSpec) -> None:
    """Both tables exist; one scan of an older table that has data but no such rows."""
    h = fs.Handle(store.spark, store.table_dir(spec.id))
    both = [_dir(store, spec.id, n) for n in ("placement", "file_times")]
    if all(map(h.exists, both)):
        return
    for at in both:
        h.delete(at, True)
    if any(n.startswith("event_date=") for n in h.names(store.data_dir(spec.id))):
        rows, times = (at + ".new" for at in both)
        _write(describe(store.spark.read.schema(spec.storage_schema()).parquet(store.data_dir(spec.id))), rows)
        _times(store.spark.read.schema(PLACEMENT).parquet(rows)).write.mode("overwrite").parquet(times)
        h.rename(rows, both[0])
        h.rename(times, both[1])
    for at in both:
        h.mkdirs(at)


def placement(store: LogStore, spec: SourceSpec) -> DataFrame:
    return store.spark.read.schema(PLACEMENT).parquet(_dir(store, spec.id, "placement"))


def file_times(store: LogStore, spec: SourceSpec) -> DataFrame:
    """One row per data file, dead ones included."""
    times = store.spark.read.schema(TIMES).parquet(_dir(store, spec.id, "file_times"))
    return times.dropDuplicates(["event_date", "data_file"])


class Live:
    """Names of the data files that are there, one directory listing for each date asked for."""

    def __init__(self, store: LogStore, spec: SourceSpec):
        self.handle, self.data = fs.Handle(store.spark, store.table_dir(spec.id)), store.data_dir(spec.id)
        self.names: dict[date | None, set[str]] = {}

    def __call__(self, event_date: date | None, data_file: str) -> bool:
        if event_date not in self.names:
            self.names[event_date] = set(self.handle.names(f"{self.data}/{directory(event_date)}"))
        return data_file in self.names[event_date]


def names_frame(store: LogStore, names: list[str]) -> DataFrame:
    """The names as a column `source_file`."""
    return local_frame(store.spark, [(n,) for n in names], T.StructType([T.StructField("source_file", T.StringType())]))


def dates_of(store: LogStore, spec: SourceSpec, names: DataFrame | list[str]) -> list[date | None]:
    """Dates whose partitions hold rows of the named objects (a list, or a column `source_file`), from the placement table alone.

    The table's files are pruned by the names' range, or by the names where a list is short enough to be pushed down; the
    driver gets the data files that hold such rows."""
    ensure(store, spec)
    if isinstance(names, list):
        lo, hi = min(names, default=None), max(names, default=None)
    else:
        lo, hi = names.agg(F.min("source_file"), F.max("source_file")).collect()[0]
    if lo is None:
        return []
    if isinstance(names, list) and len(names) <= PUSHED_NAMES:
        hits = placement(store, spec).where(F.col("source_file").isin(names)).select("event_date", "data_file").distinct()
    else:
        if isinstance(names, list):
            names = names_frame(store, names)
        near = placement(store, spec).where(F.col("source_file").between(lo, hi))
        hits = near.join(names.select("source_file").distinct(), "source_file", "left_semi").select("event_date", "data_file").distinct()
    live = Live(store, spec)
    return list({r["event_date"]: None for r in hits.collect() if live(r["event_date"], r["data_file"])})


#: Names that are pushed to the Parquet reader (see `session`), which tests dictionaries and Bloom filters of row groups for each.
PUSHED_NAMES = 1_000


def lines(store: LogStore, spec: SourceSpec, keys: DataFrame) -> DataFrame:
    """(source_file, source_line, raw) of the wanted rows (columns source_file, source_line) that the table has (O-8).

    Only data files that the placement table names for these objects are opened; of those, row groups whose dictionary or
    Bloom filter shows none of the names are skipped where the names are few enough to be pushed down."""
    ensure(store, spec)
    keys = keys.select("source_file", "source_line").distinct()
    names = keys.select("source_file").distinct()
    few = [r[0] for r in names.where(F.col("source_file").isNotNull()).limit(PUSHED_NAMES + 1).collect()]
    near = placement(store, spec)
    if len(few) <= PUSHED_NAMES:
        near = near.where(F.col("source_file").isin(few)) if few else near.limit(0)
    else:
        near = near.join(names, "source_file", "left_semi")
    live = Live(store, spec)
    paths = [f"{store.data_dir(spec.id)}/{directory(r['event_date'])}/{r['data_file']}" for r in near.select("event_date", "data_file").distinct().collect()
             if live(r["event_date"], r["data_file"])]
    wanted = ["source_file", "source_line", "raw"]
    if not paths:
        return store.table(spec).select(*wanted).limit(0)
    rows = store.spark.read.schema(spec.storage_schema()).option("basePath", store.data_dir(spec.id)).parquet(*paths).select(*wanted)
    if len(few) <= PUSHED_NAMES:
        rows = rows.where(F.col("source_file").isin(few))
    return rows.join(keys, ["source_file", "source_line"], "left_semi").select(*wanted)


@dataclass
class DataFile:
    path: str
    min_time: datetime | None
    max_time: datetime | None
    n_rows: int


def newest_files(store: LogStore, spec: SourceSpec, time_from: datetime | None = None, time_to: datetime | None = None,
                 after: datetime | None = None, only_untimed: bool = False, leave_out: DataFrame | None = None) -> Iterator[DataFile]:
    """Data files that may hold rows asked for, by falling greatest time; files that only give rows without a time come last.

    `after`: only rows of that time or older, and rows without a time.  `leave_out` (event_date, data_file): files known to
    hold none.  Sorted by Spark and fetched a part at a time."""
    ensure(store, spec)
    low, high = F.col("min_time"), F.col("max_time")
    timed = high.isNotNull() & F.lit(not only_untimed)
    for limit, bound in ((time_from, lambda x: high >= x), (time_to, lambda x: low <= x), (after, lambda x: low <= x)):
        if limit is not None:
            timed = timed & bound(F.lit(limit.isoformat(sep=" ")).cast("timestamp_ntz"))
    rest: Column = F.col("n_untimed") > 0 if time_from is None and time_to is None else F.lit(False)
    newest = F.when(timed, high)
    times = file_times(store, spec)
    if leave_out is not None:
        times = times.join(leave_out, times["event_date"].eqNullSafe(leave_out["event_date"]) & (times["data_file"] == leave_out["data_file"]), "left_anti")
    rows = (times.where(timed | rest).select("event_date", "data_file", "min_time", newest.alias("newest"), "n_rows")
            .orderBy(F.col("newest").desc_nulls_last(), "event_date", "data_file"))
    live = Live(store, spec)
    for r in rows.toLocalIterator():
        if live(r["event_date"], r["data_file"]):
            yield DataFile(f"{store.data_dir(spec.id)}/{directory(r['event_date'])}/{r['data_file']}", r["min_time"], r["newest"], r["n_rows"])


def compact_index(store: LogStore, spec: SourceSpec, min_files: int = MANY_FILES) -> bool:
    """Rewrite the tables about data files without the rows of those that are gone, once one has many files."""
    h = fs.Handle(store.spark, store.table_dir(spec.id))
    names = [n for n in ("file_times", "placement", ngrams.NAME) if h.exists(_dir(store, spec.id, n))]
    if max((len(h.sizes(_dir(store, spec.id, n))) for n in names), default=0) < min_files:
        return False
    there = (store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store.data_dir(spec.id))
             .select(F.element_at(F.split("path", "/"), -2).alias("_dir"), F.element_at(F.split("path", "/"), -1).alias("data_file")))
    of_date = F.coalesce(F.concat(F.lit("event_date="), F.col("event_date").cast("string")), F.lit(NULL_PARTITION))
    tables = {"file_times": (file_times, ["max_time"]), "placement": (placement, ["source_file"]), ngrams.NAME: (ngrams.table, ["bucket", "data_file"])}
    for name in names:
        read, key = tables[name]
        rows = read(store, spec)
        live = rows.withColumn("_dir", of_date).join(there, ["_dir", "data_file"], "left_semi").select(*rows.columns)
        live.hint("rebalance").sortWithinPartitions(*key).write.mode("overwrite").options(**BLOOM).parquet(_dir(store, spec.id, name) + ".new")
    # Cut short from here on, `ensure` builds the first two anew, and a source without filters skips nothing.
    for name in names:
        h.delete(_dir(store, spec.id, name), True)
    for name in reversed(names):
        h.rename(_dir(store, spec.id, name) + ".new", _dir(store, spec.id, name))
    return True
