"""The store: source definitions, table layout and the load manifest.

Layout under one root URI (any Hadoop file system):

    <root>/sources/<id>.json                  one JSON document per source definition
    <root>/tables/<id>/data/event_date=D/     ZSTD Parquet log rows, partitioned by event date
    <root>/tables/<id>/manifest/              Parquet rows (source_id, file_name, ingested_at, rows_ingested)
    <root>/tables/<id>/placement/, file_times/  which data files hold an object's rows, which times they span
    <root>/tables/<id>/ngrams/                n-gram filters of the data files, where the source keeps them
    <root>/tables/<id>/staging/<load_id>/     a load's output before it is published
    <root>/tables/<id>/journal/<load_id>.json a load in flight (removed once its manifest rows exist)

One writer per source at a time (plain Parquet has no snapshot isolation); readers see whole
published files only.
"""

from __future__ import annotations

import json
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog import spec as S
from tidelog.session import configure
from tidelog.sources import fs

MANIFEST_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("rows_ingested", T.IntegerType()),
])


#: How data files are written.  Where an object's name isn't in a row group's dictionary, its Bloom filter tells so.
DATA_FILE_OPTIONS = {"compression": "zstd", "parquet.bloom.filter.enabled#source_file": "true", "parquet.bloom.filter.expected.ndv#source_file": "5000"}

#: A compacted manifest is cut into files of about this size.
MANIFEST_FILE_BYTES = 32 * 1024 * 1024


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows of the driver as a DataFrame that Spark reads from Arrow: no Python worker is started for them."""
    return spark.createDataFrame(arrow_rows(rows, schema), schema)


def arrow_rows(rows: list[tuple], schema: T.StructType) -> pa.Table:
    arrow = to_arrow_schema(schema)
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


class SourceNotFound(KeyError):
    pass


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.root = fs.qualify(spark, root).rstrip("/")
        fs.mkdirs(spark, self.root + "/sources")
        if not spark.sparkContext.getCheckpointDir():  # loads checkpoint: beside the tables, where all executors can read
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or self.root + "/checkpoints")

    # --- paths -------------------------------------------------------------------------------
    def spec_path(self, sid: str) -> str:
        return f"{self.root}/sources/{sid}.json"

    def table_dir(self, sid: str) -> str:
        return f"{self.root}/tables/{sid}"

    def data_dir(self, sid: str) -> str:
        return self.table_dir(sid) + "/data"

    def manifest_dir(self, sid: str) -> str:
        return self.table_dir(sid) + "/manifest"

    def staging_dir(self, sid: str) -> str:
        return self.table_dir(sid) + "/staging"

    def journal_dir(self, sid: str) -> str:
        return self.table_dir(sid) + "/journal"

    # --- definitions (O-46 .. O-49) ----------------------------------------------------------
    def create_source(self, name: str, source_type: str, config: dict, **kw) -> S.SourceSpec:
        spec = S.new_spec(name, source_type, config, **kw)
        if fs.exists(self.spark, self.spec_path(spec.id)):
            raise S.SpecError(f"the id {spec.id!r} is taken: choose another name than {name!r}")
        for d in (self.data_dir(spec.id), self.manifest_dir(spec.id)):
            fs.mkdirs(self.spark, d)
        fs.write_text(self.spark, self.spec_path(spec.id), spec.to_json())
        return spec

    def get(self, sid: str) -> S.SourceSpec:
        p = self.spec_path(sid)
        if not fs.exists(self.spark, p):
            raise SourceNotFound(sid)
        return S.SourceSpec.from_json(fs.read_text(self.spark, p))

    def save(self, spec: S.SourceSpec) -> None:
        fs.write_text(self.spark, self.spec_path(spec.id), spec.to_json())

    def update_source(self, sid: str, **kw) -> S.SourceSpec:
        """Additive schema change (O-47); no data is rewritten, old files read NULL for new columns."""
        spec = S.evolve(self.get(sid), **kw)
        self.save(spec)
        return spec

    def list_sources(self) -> list[S.SourceSpec]:
        out = []
        for name, is_dir, _ in fs.list_dir(self.spark, self.root + "/sources"):
            if not is_dir and name.endswith(".json"):
                out.append(self.get(name[: -len(".json")]))
        return sorted(out, key=lambda s: s.name)

    def delete_source(self, sid: str) -> None:
        """Definition first, then data and manifest (O-49): a half-done drop leaves orphaned
        files, never a definition without a table."""
        self.get(sid)
        fs.delete(self.spark, self.spec_path(sid), False)
        fs.delete(self.spark, self.table_dir(sid), True)

    def mark_polled(self, sid: str, at: datetime) -> S.SourceSpec:
        spec = self.get(sid)
        spec.last_polled_at = at
        self.save(spec)
        return spec

    def size_bytes(self, sid: str) -> int:
        """Bytes of the source's table on disk (O-34)."""
        return fs.size_bytes(self.spark, self.data_dir(sid))

    def sizes_df(self) -> DataFrame:
        """(id, event_date, n_files, size_bytes) of every source's data files (O-34): one metadata-only listing of all tables,
        which Spark spreads over the cluster, summed per source and partition.  event_date is NULL for rows out of range."""
        base = f"{self.root}/tables"
        h = fs.Handle(self.spark, self.root)
        if not any(h.names(f"{base}/{sid}/data") for sid in h.names(base)):
            return self.spark.createDataFrame([], "id string, event_date date, n_files bigint, size_bytes bigint")
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/*/data")
                 .select(F.substring("path", len(base) + 2, 1 << 30).alias("path"), "length"))
        day = F.regexp_extract("path", "/event_date=([^/]*)/", 1)
        return (files.groupBy(F.element_at(F.split("path", "/"), 1).alias("id"), day.try_cast("date").alias("event_date"))
                .agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("size_bytes")))

    def sources_df(self) -> DataFrame:
        """Sources report ordered by name, with on-disk size (O-48)."""
        rows = []
        for s in self.list_sources():
            rows.append((s.id, s.name, s.source_type, json.dumps(s.config, sort_keys=True), s.prefix,
                         s.table_name, json.dumps([f.to_json() for f in s.fields]), s.retention_days,
                         s.auto_load, s.poll_minutes, s.load_days_back, s.max_size_mb, s.created_at,
                         s.last_polled_at))
        schema = ("id string, name string, source_type string, config_json string, prefix string, "
                  "table_name string, fields_json string, retention_days int, auto_load boolean, "
                  "poll_minutes int, load_days_back int, max_size_mb int, created_at timestamp_ntz, "
                  "last_polled_at timestamp_ntz")
        sizes = self.sizes_df().groupBy("id").agg(F.sum("size_bytes").alias("size_bytes"))
        sources = self.spark.createDataFrame(rows, schema).join(sizes, "id", "left")
        return sources.withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0).cast("bigint"))).orderBy("name")

    # --- table and manifest ------------------------------------------------------------------
    def table(self, spec_or_id) -> DataFrame:
        """Every row of a source (O-9), read with the definition's explicit schema: columns
        added later read as NULL in older files."""
        spec = spec_or_id if isinstance(spec_or_id, S.SourceSpec) else self.get(spec_or_id)
        self.get(spec.id)  # a dropped source must not be read or recreated
        return self.spark.read.schema(spec.storage_schema()).parquet(self.data_dir(spec.id))

    def manifest_raw(self, sid: str) -> DataFrame:
        _recover_manifest(self, sid)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.manifest_dir(sid))

    def manifest(self, sid: str) -> DataFrame:
        """Latest marker per (source_id, file_name) (O-37 upsert semantics)."""
        return upsert_latest(self.manifest_raw(sid))

    def append_manifest(self, sid: str, rows: list[tuple]) -> None:
        if rows:
            fs.append_rows(self.spark, self.manifest_dir(sid), arrow_rows(rows, MANIFEST_SCHEMA))


def _recover_manifest(store: "LogStore", sid: str) -> None:
    """A manifest swap cut short between its two renames: put the old version back."""
    mdir, old = store.manifest_dir(sid), store.table_dir(sid) + "/manifest.old"
    h = fs.Handle(store.spark, store.table_dir(sid))
    if not h.exists(mdir) and h.exists(old):
        h.rename(old, mdir)


def compact_manifest(store: "LogStore", sid: str, min_files: int = 64) -> bool:
    """Rewrite the manifest as its latest rows once it has many small files (one per load)."""
    h = fs.Handle(store.spark, store.table_dir(sid))
    mdir = store.manifest_dir(sid)
    files = [(n, size) for n, size in h.sizes(mdir) if n.endswith(".parquet")]
    if len(files) < min_files:
        return False
    _replace_manifest(store, sid, store.manifest(sid))
    return True


def forget_files(store: "LogStore", sid: str, names: list[str]) -> None:
    """Remove the load markers of the named objects, so that the next load replaces their rows."""
    gone = store.spark.createDataFrame([(n,) for n in names], "file_name string")
    _replace_manifest(store, sid, store.manifest(sid).join(gone, "file_name", "left_anti"))


def _replace_manifest(store: "LogStore", sid: str, rows: DataFrame) -> None:
    h = fs.Handle(store.spark, store.table_dir(sid))
    mdir, new = store.manifest_dir(sid), store.table_dir(sid) + "/manifest.new"
    n_files = 1 + sum(size for _, size in h.sizes(mdir)) // MANIFEST_FILE_BYTES
    h.delete(new, True)
    rows.select(*MANIFEST_SCHEMA.fieldNames()).repartition(n_files, "file_name").write.mode("overwrite").parquet(new)
    old = store.table_dir(sid) + "/manifest.old"
    h.delete(old, True)
    h.rename(mdir, old)
    h.rename(new, mdir)
    h.delete(old, True)


def upsert_latest(manifest: DataFrame) -> DataFrame:
    """Union of marker rows -> one row per (source_id, file_name), the latest by ingested_at."""
    latest = F.max_by(F.struct("ingested_at", "rows_ingested"), F.col("ingested_at"))
    return (manifest.groupBy("source_id", "file_name").agg(latest.alias("m"))
            .select("source_id", "file_name", "m.ingested_at", "m.rows_ingested"))
