"""Rewrites of whole `event_date` partitions of a source's table.

New files go to a staging folder in one Spark job; then each touched partition directory is swapped (old -> trash,
new -> place, trash removed).  A swap cut short is undone by `recover_swaps`.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.catalog import DATA_FILE_OPTIONS, LogStore, local_frame
from tidelog.operators import placement
from tidelog.operators.placement import NULL_PARTITION
from tidelog.sources import fs
from tidelog.spec import SourceSpec

#: Sampled rows of a date for each of its files, from which the bounds between files are taken.
SAMPLED = 200
#: Tasks of a rewrite in order of time, and ranges of one date, at most (beside one for each date); beyond, a range is several files.
MOST_TASKS = 1_024
MOST_RANGES = 256
NO_DATE = date(1900, 1, 1)
#: Tasks move their own files to the staging folder, which is used only once the whole job has ended; else the driver moves all, one by one.
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def partitions(store: LogStore, sid: str) -> dict[str, date | None]:
    """Directory name -> date (None: rows whose date is out of range)."""
    out = {}
    for name in fs.Handle(store.spark, store.table_dir(sid)).names(store.data_dir(sid)):
        if name.startswith("event_date="):
            out[name] = None if name == NULL_PARTITION else date.fromisoformat(name.split("=", 1)[1])
    return out


def file_stats(store: LogStore, sid: str) -> dict[str, list[tuple[str, int]]]:
    """Data files per partition with their sizes (one listing call per partition)."""
    h = fs.Handle(store.spark, store.table_dir(sid))
    return {p: [(n, sz) for n, sz in h.sizes(f"{store.data_dir(sid)}/{p}") if not n.startswith((".", "_"))]
            for p in partitions(store, sid)}


def read_parts(store: LogStore, spec: SourceSpec, parts: list[str]) -> DataFrame:
    base = store.data_dir(spec.id)
    return (store.spark.read.schema(spec.storage_schema()).option("basePath", base)
            .parquet(*[f"{base}/{p}" for p in parts]))


def recover_swaps(store: LogStore, spec: SourceSpec) -> None:
    """Undo a partition swap cut short: a trashed partition without a replacement goes back."""
    h = fs.Handle(store.spark, store.table_dir(spec.id))
    trash_root = store.table_dir(spec.id) + "/trash"
    for op in h.names(trash_root):
        for part in h.names(f"{trash_root}/{op}"):
            target = f"{store.data_dir(spec.id)}/{part}"
            if not part.endswith(".empty") and not h.exists(target):
                h.rename(f"{trash_root}/{op}/{part}", target)
        h.delete(f"{trash_root}/{op}", True)


def swap(store: LogStore, spec: SourceSpec, staged: str, parts: list[str]) -> None:
    """Replace each partition in `parts` by its staged version (absent staged = now empty)."""
    h = fs.Handle(store.spark, store.table_dir(spec.id))
    placement.record(store, spec, staged)
    trash = f"{store.table_dir(spec.id)}/trash/{uuid.uuid4().hex[:12]}"
    h.mkdirs(trash)
    data = store.data_dir(spec.id)
    staged_parts = set(h.names(staged))
    for p in parts:
        has_new = p in staged_parts
        h.rename(f"{data}/{p}", f"{trash}/{p}" + ("" if has_new else ".empty"))
        if has_new:
            h.rename(f"{staged}/{p}", f"{data}/{p}")
    for p in staged_parts - set(parts):
        if p.startswith("event_date="):
            h.rename(f"{staged}/{p}", f"{data}/{p}")
    h.delete(trash, True)
    h.delete(staged, True)


def rewrite(store: LogStore, spec: SourceSpec, parts: list[str], df: DataFrame,
            files: dict[str, int] | None = None) -> None:
    """Write `df` (rows of `parts`) into staging and swap those partitions in.

    `files` names about how many files each partition gets: a date of several files is cut into ranges of (time, file,
    line), so its files don't overlap in time but for rows of equal time, and a burst on one timestamp is split.  Where there
    are too many files for a task each, a task's sorted range is cut into files by a number of rows."""
    staged = f"{store.table_dir(spec.id)}/rewrite/{uuid.uuid4().hex[:12]}"
    out = df.select(*[f.name for f in spec.storage_schema().fields])

    def write(rows: DataFrame, **more) -> None:
        rows.write.mode("append").partitionBy("event_date").options(**DATA_FILE_OPTIONS, **MOVED_BY_TASKS, **more).parquet(staged)

    share = _share(files) if files else 1
    if share > 1:
        for most, some in _alike(out, files):
            of_dates = out.where(_dated().isin([_date(p) for p in some]))
            write(_by_time(of_dates, {p: -(-n // share) for p, n in some.items()}), maxRecordsPerFile=most)
    else:
        write(_by_time(out, files) if files else out)
    swap(store, spec, staged, parts)


def _share(files: dict[str, int]) -> int:
    """Files of one range of a date."""
    return max(1, -(-sum(files.values()) // MOST_TASKS), -(-max(files.values()) // MOST_RANGES))


def _alike(rows: DataFrame, files: dict[str, int]) -> list[tuple[int, dict[str, int]]]:
    """Partitions whose files have about as many rows (within a factor of two), and how many that are: one limit counts for a whole write."""
    counts = {r["_date"]: r["n"] for r in rows.groupBy(_dated().alias("_date")).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes: dict[int, list[tuple[int, str]]] = {}
    for p, n in files.items():
        of_file = -(-counts.get(_date(p), 0) // n)
        classes.setdefault(of_file.bit_length(), []).append((of_file, p))
    return [(max(1, max(some)[0]), {p: files[p] for _, p in some}) for some in classes.values()]


def _key() -> Column:
    """Order of a date's rows: by time, rows without one last, then file and line, so that no two are equal."""
    return F.struct(F.col("time").isNull().alias("untimed"), F.col("time"), F.col("source_file"), F.col("source_line"))


def _date(part: str) -> date:
    """A partition's date; one that no partition has stands for the NULL partition."""
    return NO_DATE if part == NULL_PARTITION else date.fromisoformat(part.split("=", 1)[1])


def _dated() -> Column:
    return F.coalesce(F.col("event_date"), F.lit(NO_DATE))


def _of_dates(rows: DataFrame, numbers: list[tuple[date, int]], name: str) -> DataFrame:
    return local_frame(rows.sparkSession, numbers, T.StructType([T.StructField("_date", T.DateType()), T.StructField(name, T.IntegerType())]))


def _by_time(rows: DataFrame, files: dict[str, int]) -> DataFrame:
    """Rows dealt by date and range of time, sorted: every range of every date is a task of its own and becomes one file."""
    many = {p: n for p, n in files.items() if n > 1}
    columns = rows.columns
    order = ["event_date", F.col("time").asc_nulls_last(), "source_file", "source_line"]
    if not many:
        return rows.repartition(len(files), "event_date").sortWithinPartitions(*order)
    starts, start = [], 0
    for p, n in files.items():
        starts.append((_date(p), start))
        start += n
    numbered = _of_dates(rows, starts, "_start")
    placed = rows.withColumn("_date", _dated()).join(F.broadcast(numbered), "_date").join(F.broadcast(_bounds(rows, many)), "_date", "left")
    placed = _ranked(placed, max(many.values()) - 1)
    return placed.select(*columns, (F.col("_start") + F.col("_rank")).alias("_place")).repartitionById(start, F.col("_place")).sortWithinPartitions(*order).select(*columns)


def _bounds(rows: DataFrame, many: dict[str, int]) -> DataFrame:
    """(_date, _bounds): n - 1 ascending keys that cut a date's rows into n nearly equal ranges, from a sample by hash.

    At most SAMPLED keys for each file to be written are sorted per date; no key reaches the driver."""
    wanted = _of_dates(rows, [(_date(p), n) for p, n in many.items()], "_n")
    dated = rows.select(_dated().alias("_date"), _key().alias("_key"), F.pmod(F.xxhash64("source_file", "source_line"), F.lit(1 << 30)).alias("_hash"))
    counts = dated.groupBy("_date").agg(F.count(F.lit(1)).alias("_rows"))
    rate = wanted.join(counts, "_date").select("_date", "_n", (F.col("_n") * SAMPLED / F.col("_rows") * (1 << 30)).alias("_below"))
    sampled = dated.join(rate, "_date").where(F.col("_hash") < F.col("_below"))
    by_key = Window.partitionBy("_date").orderBy("_key")
    of_date = Window.partitionBy("_date")
    ranked = sampled.select("_date", "_key", "_n", F.row_number().over(by_key).alias("_at"), F.count(F.lit(1)).over(of_date).alias("_all"))

    def part(at: Column) -> Column:
        return F.floor(at * F.col("_n") / F.col("_all"))

    cuts = ranked.where((part(F.col("_at")) > part(F.col("_at") - 1)) & (F.col("_at") < F.col("_all")))
    return cuts.groupBy("_date").agg(F.sort_array(F.collect_list("_key")).alias("_bounds"))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """With `_rank`: how many of a row's ascending `_bounds`, `most` at most, are not after its key (0 without bounds).

    A search by halving, a projection for each step: Spark compiles these, while it would interpret a function over the array."""
    rows = rows.select("*", _key().alias("_key"), F.lit(0).alias("_rank"))
    others = [c for c in rows.columns if c != "_rank"]
    for step in reversed([1 << k for k in range(most.bit_length())]):
        reached = F.col("_rank") + F.lit(step)
        at_most = F.coalesce(F.get("_bounds", reached - 1) <= F.col("_key"), F.lit(False))  # no bound there: no
        rows = rows.select(*others, F.when(at_most, reached).otherwise(F.col("_rank")).alias("_rank"))
    return rows


def overlaps(store: LogStore, spec: SourceSpec) -> DataFrame:
    """(event_date, n_files, n_overlaps): data files of each date, and how many begin before an earlier one ends."""
    spans = (store.table(spec).where(F.col("time").isNotNull()).groupBy("event_date", F.col("_metadata.file_name").alias("data_file"))
             .agg(F.min("time").alias("lo"), F.max("time").alias("hi")))
    before = Window.partitionBy("event_date").orderBy("lo", "hi", "data_file").rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.max("hi").over(before) > F.col("lo"), F.lit(False)).cast("int")
    return spans.select("event_date", late.alias("late")).groupBy("event_date").agg(F.count(F.lit(1)).alias("n_files"), F.sum("late").alias("n_overlaps"))


def drop_files(store: LogStore, spec: SourceSpec, names: DataFrame | list[str]) -> int:
    """Remove every row of the named objects (a list, or a column `source_file`); returns how many partitions were rewritten.

    The placement table tells which partitions hold such rows; where none does, no data file is read.  The side of names is
    broadcast only where Spark finds it small."""
    parts = [placement.directory(d) for d in placement.dates_of(store, spec, names)]
    if not parts:
        return 0
    if isinstance(names, list):
        names = placement.names_frame(store, names)
    rest = read_parts(store, spec, parts).join(names.select("source_file").distinct(), "source_file", "left_anti")
    rewrite(store, spec, parts, rest.hint("rebalance", "event_date"))
    return len(parts)
