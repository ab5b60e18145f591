import os

import pytest
from pyspark.sql import functions as F

from log_samples import write_lines
from tidelog.catalog import LogStore
from tidelog.operators import load as L
from tidelog.operators import placement
from tidelog.sources import fs
from tidelog.streaming import autoload
from tidelog.streaming.autoload import done_batches, start_autoload


def test_autoload_delivers_only_new_files(spark, workdir):
    src = os.path.join(workdir, "bucket")
    write_lines(os.path.join(src, "a.ndjson"), ['{"level":"A"}', '{"level":"B"}'])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("stream", "path", {"root": src})
    q = start_autoload(store, spec.id, available_now=True)
    q.awaitTermination()
    assert store.table(spec).count() == 2
    write_lines(os.path.join(src, "b.ndjson"), ['{"level":"C"}'])
    q = start_autoload(store, spec.id, available_now=True)
    q.awaitTermination()
    assert sorted(r["level"] for r in store.table(spec).collect()) == ["A", "B", "C"]
    assert store.manifest(spec.id).count() == 2


def test_limited_batches_and_a_batch_that_died_before_its_commit(spark, workdir, monkeypatch):
    """Two files a batch; the stream dies after the second batch was loaded, then once halfway: each file is loaded once."""
    src = os.path.join(workdir, "bucket")
    for k in range(7):
        write_lines(os.path.join(src, f"f{k}.ndjson"), ['{"level":"L%d"}' % k] * 2)
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("stream", "path", {"root": src})
    ckpt = os.path.join(workdir, "ckpt")
    loaded, real, write = [], L.load_listed, autoload.fs.write_text

    def counted(store, spec, files, now=None):
        for s in real(store, spec, files, now):
            loaded.append(s.file_name)
            yield s

    monkeypatch.setattr(autoload.L, "load_listed", counted)

    def dies(when):
        def text(spark, uri, body):
            write(spark, uri, body) if when != "before" else None
            if "/loaded/1." in uri:
                raise RuntimeError("killed")
        return text

    for when in ("before", "after"):  # without the batch's record, and with it
        monkeypatch.setattr(autoload.fs, "write_text", lambda s, u, b, w=when: write(s, u, b) if "/loaded/" not in u or "/loaded/0." in u else dies(w)(s, u, b))
        with pytest.raises(Exception):
            start_autoload(store, spec.id, ckpt, available_now=True, max_files=2).awaitTermination()
    monkeypatch.setattr(autoload.fs, "write_text", write)
    start_autoload(store, spec.id, ckpt, available_now=True, max_files=2).awaitTermination()
    assert sorted(loaded) == [f"f{k}.ndjson" for k in range(7)]
    assert {r["level"]: r["count"] for r in store.table(spec).groupBy("level").count().collect()} == {f"L{k}": 2 for k in range(7)}
    assert done_batches(store, ckpt) == [0, 1, 2, 3]


def test_batches_merge_what_they_add(spark, workdir, monkeypatch):
    """Manifest and placement don't gain files with every batch for good: a batch merges them once they are many."""
    src = os.path.join(workdir, "bucket")
    for k in range(4):
        write_lines(os.path.join(src, f"f{k}.ndjson"), ['{"level":"L%d"}' % k])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("merged", "path", {"root": src})
    merge, index = autoload.compact_manifest, autoload.placement.compact_index
    monkeypatch.setattr(autoload, "compact_manifest", lambda store, sid: merge(store, sid, 2))
    monkeypatch.setattr(autoload.placement, "compact_index", lambda store, spec: index(store, spec, 2))
    start_autoload(store, spec.id, os.path.join(workdir, "ckpt"), available_now=True, max_files=1).awaitTermination()
    h = fs.Handle(spark, store.root)
    assert len([n for n in h.names(store.manifest_dir(spec.id)) if n.endswith(".parquet")]) == 1
    assert len([n for n in h.names(f"{store.table_dir(spec.id)}/file_times") if n.endswith(".parquet")]) == 1
    assert store.manifest(spec.id).count() == 4 and store.table(spec).count() == 4
    assert placement.dates_of(store, spec, ["f0.ndjson"]) and not placement.dates_of(store, spec, ["f9.ndjson"])


def test_a_batch_costs_few_jobs_and_no_new_code(spark, workdir, monkeypatch):
    """The load's time isn't a constant of the plan, rows about files are written without jobs, and what they take on disk follows their number."""
    src = os.path.join(workdir, "bucket")
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("cheap", "path", {"root": src})
    plans, real = [], L.N.parse_rows

    def looked_at(*args):
        out = real(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(L.N, "parse_rows", looked_at)
    write_lines(os.path.join(src, "a.ndjson"), ['{"level":"A","time":"2024-01-01 00:00:00"}', '{"level":"B"}'])
    assert L.sync_source(store, spec) == 1
    write_lines(os.path.join(src, "b.ndjson"), ['{"level":"C","time":"%s"}' % t for t in ("2024-01-01 00:00:01", "2024-01-02 00:00:00")] + ['{"time":300000000000}'])
    spark.sparkContext.setJobGroup(workdir, "a load")
    try:
        assert L.sync_source(store, spec) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    year = store.manifest(spec.id).selectExpr("string(max(year(ingested_at)))").collect()[0][0]
    assert len(plans) == 2 and not any(f"{year}-" in p for p in plans)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(workdir)) <= 14
    for name, most in (("placement", 150_000), ("file_times", 20_000), ("manifest", 20_000)):
        sizes = [n for f, n in fs.Handle(spark, store.root).sizes(f"{store.table_dir(spec.id)}/{name}") if f.endswith(".parquet")]
        assert len(sizes) == 2 and max(sizes) < most
    counted = set(placement.file_times(store, spec).select("event_date", "data_file", "n_rows", F.col("min_time").cast("string")).collect())
    found = store.table(spec).groupBy("event_date", "_metadata.file_name").agg(F.count(F.lit(1)), F.min("time").cast("string"))
    assert counted == set(found.collect()) and len(counted) == 5 and {r["rows_ingested"] for r in store.manifest(spec.id).collect()} == {2, 3}
