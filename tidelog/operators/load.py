"""Incremental, idempotent loading (O-7, O-31, O-35 ... O-39).

One load group = one pair of Spark jobs over many files (split statistics, then parse + write),
parallel across file splits.  A group is published in three steps:

1. a journal entry names the group's load id and files;
2. the rows are written to a staging folder and counted per file there; rows that the table still
   holds of these files go (a load replaces a file's rows; the placement table tells where they lie, so
   names never seen cost no read of the table); the staged files are renamed into the table;
3. manifest rows are appended (empty valid files included, T30); then the journal entry goes.

A group whose job failed leaves no rows (Spark aborts the write); a crash after step 2 leaves a
journal entry, and the next write on the source removes that load's files by their load id.
Files whose job fails are isolated by splitting the group, so one bad file never fails others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.catalog import DATA_FILE_OPTIONS, LogStore
from tidelog.functions import extract as X
from tidelog.operators import partitions as P
from tidelog.operators import placement
from tidelog.sources import fs, listing
from tidelog.sources import ndjson as N
from tidelog.spec import SourceSpec

# Split-table broadcast budget: one row per file split, with the object's path as scanned and as listed, checked from the listing before a group runs.
BROADCAST_SPLIT_BYTES = 64 * 1024 * 1024
SPLIT_ROW_OVERHEAD = 48
# Bound on one group: files and bytes per pair of jobs.
GROUP_MAX_FILES = 20_000
GROUP_MAX_BYTES = 512 * 1024 ** 3
#: Input of one task of a load, each split counted with what opening it costs; a task reads many short splits.
TASK_BYTES = 32 * 1024 * 1024
SPLIT_OPEN_BYTES = 1024 * 1024
#: Bytes of a method that the JVM still compiles; extraction generated as one method has more and would be interpreted.
LONGEST_COMPILED = 8000


def _tasks(spark: SparkSession, group: list[tuple[str, str, int]]) -> int:
    """Tasks of a group's jobs at most.  Spark gives every split shorter than its cost of opening a task of its own."""
    split = _split_bytes(spark)
    whole = sum(size + max(1, -(-size // split)) * min(split, SPLIT_OPEN_BYTES) for _, _, size in group)
    return max(spark.sparkContext.defaultParallelism, -(-whole // TASK_BYTES))


@contextmanager
def _pinned(spark: SparkSession, least: int, most: int) -> Iterator[None]:
    """Scans have from `least` to about `most` tasks meanwhile, and no stage runs as a method too long for the JVM to compile."""
    pins = {"spark.sql.files.minPartitionNum": least, "spark.sql.files.maxPartitionNum": most, "spark.sql.codegen.hugeMethodLimit": LONGEST_COMPILED}
    prev = {k: spark.conf.get(k, None) for k in pins}
    try:
        for k, v in pins.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in prev.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@dataclass
class LoadSummary:
    file_name: str
    rows_inserted: int = 0
    lines_skipped: int = 0
    already_loaded: bool = False
    error: str = ""


def utc_now() -> datetime:
    """Load timestamp: UTC wall clock, naive, at millisecond precision."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


def _split_bytes(spark: SparkSession) -> int:
    v = spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728")
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(v)))


def plan_groups(files: list[tuple[str, str, int]], split_bytes: int) -> list[list[tuple[str, str, int]]]:
    """Cut (name, path, size) into groups bounded by files, bytes and broadcast size."""
    groups, cur, cur_bytes, cur_split_bytes = [], [], 0, 0
    for f in files:
        name, path, size = f
        row_bytes = max(1, -(-size // split_bytes)) * (2 * len(path) + SPLIT_ROW_OVERHEAD)
        if cur and (len(cur) >= GROUP_MAX_FILES or cur_bytes + size > GROUP_MAX_BYTES
                    or cur_split_bytes + row_bytes > BROADCAST_SPLIT_BYTES):
            groups.append(cur)
            cur, cur_bytes, cur_split_bytes = [], 0, 0
        cur.append(f)
        cur_bytes += size
        cur_split_bytes += row_bytes
    if cur:
        groups.append(cur)
    return groups


def planned_groups(store: LogStore, spec: SourceSpec, files: DataFrame) -> Iterator[list[tuple[str, str, int]]]:
    """The groups of (name, path, size) rows in name order; the driver holds one group at a time.

    What fits in one group by its number of files is cut here.  A longer list is numbered by Spark: running sums of each
    file's share of the three bounds (files, bytes, split rows) over ranges of names, the ranges' own sums added, and a new
    group whenever the sum passes a whole number.  The numbered list is written once and read back group by group."""
    spark, split = store.spark, _split_bytes(store.spark)
    files = files.select("name", "path", "size")
    cores = spark.sparkContext.defaultParallelism
    with _pinned(spark, cores, 4 * cores):  # metadata only, however small the splits of the load are
        first = files.limit(GROUP_MAX_FILES + 1).collect()
    if len(first) <= GROUP_MAX_FILES:
        yield from plan_groups(sorted((r["name"], r["path"], r["size"]) for r in first), split)
        return
    at = f"{store.staging_dir(spec.id)}/plan-{uuid.uuid4().hex[:12]}"
    split_rows = F.greatest(F.lit(1), F.ceil(F.col("size") / split)) * (2 * F.length("path") + SPLIT_ROW_OVERHEAD)
    share = F.lit(1.0 / GROUP_MAX_FILES) + F.col("size") / GROUP_MAX_BYTES + split_rows / BROADCAST_SPLIT_BYTES
    (files.select("*", share.alias("share")).repartitionByRange("name").select("*", F.spark_partition_id().alias("range"))
     .write.parquet(at + "/listed"))
    listed = spark.read.parquet(at + "/listed")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = listed.groupBy("range").agg(F.sum("share").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("start"))
    so_far = F.col("start") + F.sum("share").over(Window.partitionBy("range").orderBy("name"))
    (listed.join(ranges, "range").select("name", "path", "size", F.floor(so_far).alias("number"))
     .repartition("number").write.partitionBy("number").parquet(at + "/groups"))
    h = fs.Handle(spark, at)
    for number in sorted(int(n.split("=", 1)[1]) for n in h.names(at + "/groups") if n.startswith("number=")):
        group = spark.read.schema("name string, path string, size bigint").parquet(f"{at}/groups/number={number}")
        yield sorted((r["name"], r["path"], r["size"]) for r in group.collect())
    h.delete(at, True)


def recover(store: LogStore, spec: SourceSpec) -> int:
    """Undo loads interrupted between publishing rows and writing their manifest rows."""
    spark = store.spark
    h = fs.Handle(spark, store.table_dir(spec.id))
    undone = 0
    for name in h.names(store.journal_dir(spec.id)):
        if not name.endswith(".json"):
            continue
        entry = json.loads(fs.read_text(spark, f"{store.journal_dir(spec.id)}/{name}"))
        ts = datetime.fromisoformat(entry["ingested_at"])
        committed = (store.manifest_raw(spec.id)
                     .where((F.col("ingested_at") == F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")) & F.col("file_name").isin(entry["files"]))
                     .limit(1).count() > 0)
        if not committed and entry.get("job"):
            for p in fs.glob(spark, f"{store.data_dir(spec.id)}/*/part-*{entry['job']}*"):
                h.delete(p, False)
            undone += 1
        for staged in (entry["load_id"], entry["load_id"] + ".files"):
            h.delete(f"{store.staging_dir(spec.id)}/{staged}", True)
        h.delete(f"{store.journal_dir(spec.id)}/{name}", False)
    return undone


def staged_job_id(h: "fs.Handle", stage: str) -> str | None:
    """The write job's id that Spark puts in every output file name (part-NNNNN-<id>...)."""
    for part in h.names(stage):
        for f in h.names(f"{stage}/{part}"):
            if f.startswith("part-"):
                return f.split("-", 2)[2].split(".", 1)[0][:36]
    return None


def publish_staged(store: LogStore, spec: SourceSpec, stage: str, described: pa.Table | None = None) -> None:
    """Move staged partitions into the table: a new date directory in one rename, files of an
    existing date one by one (their names are unique per write job).  Where their rows lie is recorded first."""
    placement.record(store, spec, stage, described)
    h = fs.Handle(store.spark, store.table_dir(spec.id))
    data = store.data_dir(spec.id)
    existing = set(h.names(data))
    for part in h.names(stage):
        if not part.startswith("event_date="):
            continue
        if part not in existing:
            h.rename(f"{stage}/{part}", f"{data}/{part}")
            continue
        for fname in h.names(f"{stage}/{part}"):
            if not fname.startswith((".", "_")):
                h.rename(f"{stage}/{part}/{fname}", f"{data}/{part}/{fname}")


def _load_group(store: LogStore, spec: SourceSpec, group: list[tuple[str, str, int]],
                ingested_at: datetime) -> list[LoadSummary]:
    spark = store.spark
    load_id = "L" + ingested_at.strftime("%Y%m%d%H%M%S%f") + uuid.uuid4().hex[:8]
    stage = f"{store.staging_dir(spec.id)}/{load_id}"
    journal = f"{store.journal_dir(spec.id)}/{load_id}.json"
    fs.write_text(spark, journal, json.dumps({"load_id": load_id, "ingested_at": ingested_at.isoformat(),
                                              "files": [n for n, _, _ in group]}))
    root_q = fs.qualify(spark, spec.root_uri)
    paths = [p for _, p, _ in group]
    # Pin the split layout for both jobs of the group (it otherwise follows the live core count).
    with _pinned(spark, spark.sparkContext.defaultParallelism, _tasks(spark, group)):
        lines = N.scan_lines(spark, paths)
        loaded_at = F.lit(ingested_at.isoformat(sep=" ")).cast("timestamp_ntz")
        splits = N.split_table(lines).withColumn("ingested_at", loaded_at).checkpoint(eager=True)
        # One row per file of the group (bounded by the group size) with its split count: its first split's, as every split has lines.
        per_file = {r["source_path"]: r for r in splits.where(F.col("base") == 0).select(
            "source_path", "n_splits", F.col("file_nonblank").alias("nonblank"), F.col("file_max_len").alias("max_len")).collect()}
        n_splits = sum(r["n_splits"] for r in per_file.values())
        avg_path = sum(len(p) for p in paths) / max(1, len(paths))
        bcast = n_splits * (2 * avg_path + SPLIT_ROW_OVERHEAD) <= BROADCAST_SPLIT_BYTES
        rows = N.parse_rows(N.numbered_lines(lines, splits, bcast), spec.fields, root_q, spec.partition_unit)
        # One shuffle so each date gets few, large files whatever the input order: adaptive
        # execution merges small dates and splits a date that holds a large share of the rows.
        rows = rows.hint("rebalance", "event_date")
        rows.write.mode("overwrite").partitionBy("event_date").options(**DATA_FILE_OPTIONS).parquet(stage)
    inserted, described = placement.staged_counts(store, spec, stage)
    job = staged_job_id(fs.Handle(spark, stage), stage)
    fs.write_text(spark, journal, json.dumps({"load_id": load_id, "ingested_at": ingested_at.isoformat(),
                                              "files": [n for n, _, _ in group], "job": job}))
    P.drop_files(store, spec, [n for n, _, _ in group])
    publish_staged(store, spec, stage, described)
    summaries, marks = [], []
    for name, path, size in group:
        st = per_file.get(path) or per_file.get(fs.qualify(spark, path))
        if st is None and size > 0:
            summaries.append(LoadSummary(name, error="Spark's reader gives no line of this object"))
            continue
        if st is not None and st["max_len"] is not None and st["max_len"] >= X.MAX_LINE_BYTES:
            summaries.append(LoadSummary(name, error="line longer than the 10 MiB limit"))
            continue
        n_ins = int(inserted.get(name, 0))
        nonblank = int(st["nonblank"]) if st is not None else 0
        summaries.append(LoadSummary(name, rows_inserted=n_ins, lines_skipped=nonblank - n_ins))
        marks.append((spec.id, name, ingested_at, n_ins))
    store.append_manifest(spec.id, marks)
    fs.delete(spark, journal, False)
    fs.delete(spark, stage, True)
    return summaries


def _load_isolated(store, spec, group, ingested_at) -> list[LoadSummary]:
    """Load a group; where its job fails, halve it until each bad file stands alone, so that every good one loads.

    Files whose markers landed before the failure are not loaded again.
    """
    try:
        return _load_group(store, spec, group, ingested_at)
    except Exception as e:  # noqa: BLE001 - a failed job is reported per file
        recover(store, spec)
        marked = {r["file_name"]: r["rows_ingested"] for r in store.manifest(spec.id)
                  .where(F.col("file_name").isin([n for n, _, _ in group])).collect()}
        done = [LoadSummary(n, rows_inserted=marked[n]) for n, _, _ in group if n in marked]
        rest = [x for x in group if x[0] not in marked]
        if len(rest) <= 1:
            return done + [LoadSummary(n, error=str(e)) for n, _, _ in rest]
        mid = len(rest) // 2
        return done + _load_isolated(store, spec, rest[:mid], ingested_at) + _load_isolated(store, spec, rest[mid:], ingested_at)


def load_file_list(store: LogStore, spec: SourceSpec, files: list[tuple[str, str, int]],
                   now: datetime | None = None) -> list[LoadSummary]:
    """Load (name, path, size) files that are not yet loaded; results in the given order."""
    out = {s.file_name: s for s in _load_groups(store, spec, plan_groups(files, _split_bytes(store.spark)), now)}
    return [out[n] for n, _, _ in files]


def load_listed(store: LogStore, spec: SourceSpec, files: DataFrame, now: datetime | None = None) -> Iterator[LoadSummary]:
    """Load the files of a listing (name, path, size) that are not yet loaded, group by group; one summary each."""
    return _load_groups(store, spec, planned_groups(store, spec, files), now)


def _load_groups(store: LogStore, spec: SourceSpec, groups, now: datetime | None) -> Iterator[LoadSummary]:
    recover(store, spec)
    P.recover_swaps(store, spec)
    ingested_at = now or utc_now()
    for g in groups:
        yield from _load_isolated(store, spec, g, ingested_at)


def load_files(store: LogStore, spec_or_id, names: list[str], now: datetime | None = None) -> list[LoadSummary]:
    """Load an explicit list (O-38): caller's order kept, already-loaded names skipped, one
    summary per name, a failing file reported without failing the rest."""
    spark = store.spark
    spec = spec_or_id if isinstance(spec_or_id, SourceSpec) else store.get(spec_or_id)
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
    loaded = {r["name"] for r in wanted.join(
        store.manifest_raw(spec.id).select(F.col("file_name").alias("name")), "name", "left_semi").collect()}
    todo = [n for n in dict.fromkeys(names) if n not in loaded]
    known = {}
    if todo:
        # Stat only the named objects: the cost follows the list, not the bucket.
        root_q = fs.qualify(spark, spec.root_uri).rstrip("/")
        h = fs.Handle(spark, root_q)
        for n in todo:
            st = h.status(f"{root_q}/{n}")
            if st is not None:
                known[n] = (n, st[0], st[1])
    files = [known[n] for n in todo if n in known]
    done = {s.file_name: s for s in load_file_list(store, spec, files, now)}
    out = []
    for n in names:
        if n in loaded:
            out.append(LoadSummary(n, already_loaded=True))
        elif n in done:
            out.append(done[n])
        else:
            out.append(LoadSummary(n, error="object not found"))
    return out


def pending_files(store: LogStore, spec: SourceSpec, now: datetime | None = None, prefix: str | None = None):
    """New-file discovery (O-35): listing under the prefix -> age filter -> anti-join manifest."""
    lst = listing.list_files(store.spark, spec.root_uri, spec.prefix if prefix is None else prefix)
    lst = listing.filter_by_age(lst, spec.load_days_back, now)
    return listing.new_files(lst, store.manifest_raw(spec.id))


def sync_source(store: LogStore, spec_or_id, now: datetime | None = None) -> int:
    """Load every new file (O-39); returns how many loaded successfully."""
    return sum(1 for s in sync(store, spec_or_id, now) if not s.error)


def sync(store: LogStore, spec_or_id, now: datetime | None = None) -> Iterator[LoadSummary]:
    """Load every new file; one summary per file, failed ones included, as the groups are done."""
    spec = spec_or_id if isinstance(spec_or_id, SourceSpec) else store.get(spec_or_id)
    yield from load_listed(store, spec, pending_files(store, spec, now), now)


def sync_summaries(store: LogStore, spec_or_id, now: datetime | None = None) -> list[LoadSummary]:
    """`sync` as a list, for a number of files that the driver can hold."""
    return list(sync(store, spec_or_id, now))


def listing_with_flag(store: LogStore, spec: SourceSpec, prefix: str | None = None, now: datetime | None = None):
    """Listing with a `loaded` flag and an optional prefix override (O-3)."""
    lst = listing.list_files(store.spark, spec.root_uri, spec.prefix if prefix is None else prefix)
    lst = listing.filter_by_age(lst, spec.load_days_back, now)
    return listing.with_loaded_flag(lst, store.manifest_raw(spec.id))
