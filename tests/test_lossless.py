"""Loads, rewrites and schedules that must neither lose nor repeat rows."""

import os
from datetime import datetime

from log_samples import write_lines
from tidelog.catalog import LogStore, forget_files
from tidelog.functions import extract as X
from tidelog.operators import load as L
from tidelog.operators import partitions as P
from tidelog.operators import retention as R
from tidelog.operators import search as Q
from tidelog.plans.maintenance import run_maintenance
from tidelog.streaming.autoload import failed_files, start_autoload


def _source(spark, workdir, files, name="src", **kw):
    src = os.path.join(workdir, "bucket")
    os.makedirs(src, exist_ok=True)
    for f, lines in files.items():
        write_lines(os.path.join(src, f), lines)
    store = LogStore(spark, os.path.join(workdir, "store"))
    return store, store.create_source(name, "path", {"root": src}, **kw), src


def _names(store, spec):
    return sorted((r["source_file"], r["source_line"]) for r in store.table(spec).select("source_file", "source_line").collect())


def test_special_characters_in_names(spark, workdir):
    odd = ["a b.ndjson", "c+d%20e.ndjson", "x[1]{2}.ndjson", "d/ü#.ndjson"]
    store, spec, _ = _source(spark, workdir, {n: ['{"msg":"1"}', "junk", '{"msg":"3"}'] for n in odd})
    res = L.sync_summaries(store, spec)
    assert sorted((r.file_name, r.rows_inserted, r.lines_skipped, r.error) for r in res) == sorted((n, 2, 1, "") for n in odd)
    assert _names(store, spec) == sorted((n, k) for n in odd for k in (1, 3))
    assert Q.raw_line(store.table(spec), "a b.ndjson", 3) == '{"msg":"3"}'


def test_unreadable_name_is_an_error_not_a_marker(spark, workdir):
    store, spec, _ = _source(spark, workdir, {"_x.ndjson": ['{"msg":"1"}'], "y.ndjson": ['{"msg":"2"}']})
    res = {r.file_name: r for r in L.load_files(store, spec, ["_x.ndjson", "y.ndjson"])}
    assert res["_x.ndjson"].error and not res["y.ndjson"].error
    assert [r["file_name"] for r in store.manifest(spec.id).collect()] == ["y.ndjson"]


def test_second_load_replaces_rows(spark, workdir):
    line = '{"time":"2024-01-0%d 00:00:00","msg":"%s"}'
    store, spec, src = _source(spark, workdir, {"a.ndjson": [line % (d, "old") for d in (1, 2)], "b.ndjson": [line % (1, "b")]})
    L.sync_source(store, spec)
    forget_files(store, spec.id, ["a.ndjson"])
    write_lines(os.path.join(src, "a.ndjson"), [line % (d, "new") for d in (2, 3, 4)])
    assert L.sync_source(store, spec) == 1
    rows = sorted((r["source_file"], r["msg"]) for r in store.table(spec).collect())
    assert rows == [("a.ndjson", "new")] * 3 + [("b.ndjson", "b")]


def test_numbers_beyond_double_are_no_text(spark, workdir):
    store, spec, _ = _source(spark, workdir, {"a.ndjson": ['{"msg":1e400,"level":"Infinity"}', '{"msg":"Infinity"}']})
    L.sync_source(store, spec)
    assert sorted((r["source_line"], r["msg"], r["level"]) for r in store.table(spec).collect()) == [(1, None, "Infinity"), (2, "Infinity", None)]


def test_compaction_converges_with_one_large_date(spark, workdir, monkeypatch):
    big = ['{"time":"2024-03-01 00:00:%02d","msg":"%s"}' % (k % 60, os.urandom(24).hex()) for k in range(4000)]
    store, spec, src = _source(spark, workdir, {"big.ndjson": big})
    L.sync_source(store, spec)
    for k in range(3):
        write_lines(os.path.join(src, f"s{k}.ndjson"), ['{"time":"2024-03-0%d 01:00:00","msg":"s"}' % d for d in (1, 2, 3)])
        L.sync_source(store, spec)
    monkeypatch.setattr(R, "TARGET_FILE_BYTES", 64 * 1024)
    before = _names(store, spec)
    R.compact(store, spec, only_fragmented=True)
    files = P.file_stats(store, spec.id)
    assert len(files["event_date=2024-03-02"]) == 1 and len(files["event_date=2024-03-01"]) > 2
    R.compact(store, spec)
    files = P.file_stats(store, spec.id)
    R.compact(store, spec, only_fragmented=True)
    assert P.file_stats(store, spec.id) == files and _names(store, spec) == before


def test_size_cap_trims_the_oldest(spark, workdir):
    lines = ['{"time":"2024-01-%02d %02d:%02d:%02d","msg":"%s"}' % (1 + k // 1200, k // 60 % 20, k % 60, k % 60, os.urandom(150).hex())
             for k in range(12000)]
    store, spec, _ = _source(spark, workdir, {"a.ndjson": lines}, max_size_mb=1)
    L.sync_source(store, spec)
    times = sorted(r["time"] for r in store.table(spec).select("time").collect())
    size = store.size_bytes(spec.id)
    assert size > 2**20
    res = R.apply_retention(store, spec, datetime(2024, 2, 1))
    left = sorted(r["time"] for r in store.table(spec).select("time").collect())
    assert 0 < res.rows_deleted == len(times) - len(left) and left == times[-len(left):]
    assert res.compacted and res.bytes_reclaimed == size - res.size_bytes > 0


def test_migration_twice_and_source_without_rows(spark, workdir):
    store, spec, _ = _source(spark, workdir, {}, name="one")
    store.create_source("two", "path", {"root": workdir}, partition_unit="month")
    store.create_source("bare", "path", {"root": workdir})
    t = datetime(2024, 1, 15)
    cols = "source_id string, raw string, source_file string, source_line int, ingested_at timestamp_ntz, time timestamp_ntz, level string, msg string, file_hash string"
    rows = spark.createDataFrame([("one", "{}", "f", 1, t, t, "A", None, "h"), ("two", "{}", "g", 1, t, None, "B", "m", "h")], cols)
    marks = spark.createDataFrame([(s, f, t, n) for s, f, n in (("one", "f", 1), ("two", "g", 1), ("bare", "old", 7))],
                                  "source_id string, file_name string, ingested_at timestamp_ntz, rows_ingested long")
    for _ in range(2):
        assert R.migrate_legacy(store, rows, marks) == {"one": 1, "two": 1}
    assert [store.table(s).count() for s in ("one", "two", "bare")] == [1, 1, 0]
    assert [store.manifest_raw(s).count() for s in ("one", "two", "bare")] == [1, 1, 1]
    assert list(P.partitions(store, "two")) == ["event_date=2024-01-01"]


def test_page_reads_few_partitions_and_stays_exact(spark, workdir):
    lines = ['{"time":"2024-01-%02d 00:%02d:00","msg":"%d"}' % (1 + k % 28, k // 28, k) for k in range(28 * 20)]
    lines += ['{"msg":"none"}', '{"time":"2150-01-01 00:00:00","msg":"far"}', '{"time":"1950-01-01 00:00:00","msg":"early"}']
    store, spec, _ = _source(spark, workdir, {"a.ndjson": lines})
    L.sync_source(store, spec)
    t, dates = store.table(spec), list(P.partitions(store, spec.id).values())
    key = lambda df: [(r["time"], r["source_line"]) for r in df.collect()]
    for offset, size in ((0, 5), (0, 30), (25, 30), (500, 100), (561, 10), (900, 5)):
        assert key(Q.newest_page(t, spec, dates, offset, size)) == key(Q.page(t, spec, offset, size))
    rows = t.orderBy(*Q.order()).collect()
    for k in (0, 1, 30, 300, 555, 560, 561, 562):
        cur = (rows[k]["time"], rows[k]["source_file"], rows[k]["source_line"])
        assert key(Q.keyset_page(t, spec, cur, 10, dates)) == [(r["time"], r["source_line"]) for r in rows[k + 1:k + 12]]
    near = Q.newest_rows(t, dates, 6)
    assert near.select("event_date").distinct().count() <= 2 and len(near.inputFiles()) >= 1


def test_pick_list_of_any_length(spark):
    df = spark.createDataFrame([("a 2999 b",), ("none",)], "raw string")
    assert [r["raw"] for r in df.where(Q.contains_any([f"{k}" for k in range(900, 3000)])).collect()] == ["a 2999 b"]
    assert df.where(Q.contains_any([])).count() == 0


def test_bad_file_does_not_stop_the_stream(spark, workdir, monkeypatch):
    monkeypatch.setattr(X, "MAX_LINE_BYTES", 100)
    store, spec, src = _source(spark, workdir, {"bad.ndjson": ['{"msg":"%s"}' % ("y" * 200)], "ok.ndjson": ['{"msg":"1"}']})
    start_autoload(store, spec.id, available_now=True).awaitTermination()
    assert _names(store, spec) == [("ok.ndjson", 1)] and list(failed_files(store, spec.id)) == ["bad.ndjson"]
    write_lines(os.path.join(src, "bad.ndjson"), ['{"msg":"short"}'])
    write_lines(os.path.join(src, "new.ndjson"), ['{"msg":"2"}'])
    start_autoload(store, spec.id, available_now=True).awaitTermination()
    assert [n for n, _ in _names(store, spec)] == ["bad.ndjson", "new.ndjson", "ok.ndjson"] and not failed_files(store, spec.id)


def test_maintenance_reports_bad_files_and_reencodes_all(spark, workdir, monkeypatch):
    monkeypatch.setattr(X, "MAX_LINE_BYTES", 100)
    store, spec, src = _source(spark, workdir, {"bad.ndjson": ['{"msg":"%s"}' % ("y" * 200)], "ok.ndjson": ['{"msg":"1"}']}, auto_load=True)
    idle = store.create_source("idle", "path", {"root": src + "/none"})
    row = [("{}", "f", 1, datetime(2024, 1, 3), datetime(2024, 1, 3), None, None, None, None, None, datetime(2024, 1, 3).date())]
    (spark.createDataFrame(row, store.table(idle).schema).write.mode("append").option("compression", "snappy")
     .partitionBy("event_date").parquet(store.data_dir(idle.id)))
    reps = {r.source_id: r for r in run_maintenance(store, datetime(2024, 6, 1))}
    assert reps["src"].files_loaded == 1 and len(reps["src"].errors) == 1 and "bad.ndjson" in reps["src"].errors[0]
    assert reps["idle"].reencoded_partitions == 1 and not R.legacy_partitions(store, "idle") and store.table(idle).count() == 1


def test_good_files_between_many_bad_ones_load(spark, workdir, monkeypatch):
    bad = [True, True, True, True, False, False, True, False]
    store, spec, _ = _source(spark, workdir, {f"{k}.ndjson": ['{"msg":"1"}'] for k in range(8)})
    load = L._load_group

    def fails(store, spec, group, ingested_at):
        if any(bad[int(n[0])] for n, _, _ in group):
            raise OSError("injected")
        return load(store, spec, group, ingested_at)

    monkeypatch.setattr(L, "_load_group", fails)
    assert [bool(r.error) for r in L.sync_summaries(store, spec)] == bad
    assert _names(store, spec) == [(f"{k}.ndjson", 1) for k in (4, 5, 7)]
