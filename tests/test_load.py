import os
import random

from pyspark.sql import functions as F

from log_samples import SAMPLE, write_lines
from tidelog.catalog import LogStore
from tidelog.functions import extract as X
from tidelog.operators import load as L
from tidelog.sources import fs


def test_sample_load_counts_and_marker(sample_store):
    store, spec, _, summaries = sample_store
    s = summaries[0]
    assert (s.rows_inserted, s.lines_skipped, s.already_loaded, s.error) == (4, 1, False, "")
    t = store.table(spec)
    assert sorted(r["source_line"] for r in t.select("source_line").collect()) == [2, 3, 4, 5]
    m = store.manifest(spec.id).collect()
    assert [(r["file_name"], r["rows_ingested"]) for r in m] == [("logs/a.ndjson", 4)]
    assert t.select("ingested_at").distinct().count() == 1


def test_reload_is_a_no_op_and_summary_order(sample_store):
    store, spec, src, _ = sample_store
    write_lines(os.path.join(src, "logs", "b.ndjson"), ['{"level":"X"}'])
    res = L.load_files(store, spec, ["logs/b.ndjson", "logs/a.ndjson", "logs/missing"])
    assert [r.file_name for r in res] == ["logs/b.ndjson", "logs/a.ndjson", "logs/missing"]
    assert res[0].rows_inserted == 1 and res[1].already_loaded and res[2].error
    assert L.sync_source(store, spec) == 0
    assert store.table(spec).count() == 5


def test_line_numbers_across_many_splits(spark, workdir):
    rnd = random.Random(7)
    src = os.path.join(workdir, "bucket")
    expected = {}
    for fidx in range(3):
        lines = []
        for n in range(1, 1501):
            kind = rnd.random()
            if kind < 0.1:
                lines.append("")
            elif kind < 0.2:
                lines.append("garbage %d" % n)
            else:
                lines.append('{"level":"L","msg":"%s"}' % ("x" * rnd.randint(0, 300) + "#" + str(n)))
                expected[(f"f{fidx}.ndjson", n)] = n
        write_lines(os.path.join(src, f"f{fidx}.ndjson"), lines, newline="\r\n" if fidx == 1 else "\n")
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("splits", "path", {"root": src})
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        L.sync_source(store, spec)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    rows = store.table(spec).select("source_file", "source_line", "msg", "raw").collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert int(r["msg"].rsplit("#", 1)[1]) == r["source_line"]
        assert not r["raw"].endswith("\r")


def test_empty_file_is_marked(spark, workdir):
    src = os.path.join(workdir, "bucket")
    os.makedirs(src)
    open(os.path.join(src, "empty.ndjson"), "w").close()
    write_lines(os.path.join(src, "junk.ndjson"), ["not json", "   "])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("empty", "path", {"root": src})
    # Spark's file listing leaves out zero-byte objects (they hold no line); a file whose lines
    # are all skipped or blank is loaded and marked with 0 rows (T30).
    assert L.sync_source(store, spec) == 1
    m = {r["file_name"]: r["rows_ingested"] for r in store.manifest(spec.id).collect()}
    assert m == {"junk.ndjson": 0}


def test_long_line_fails_only_that_file(spark, workdir, monkeypatch):
    monkeypatch.setattr(X, "MAX_LINE_BYTES", 100)
    src = os.path.join(workdir, "bucket")
    write_lines(os.path.join(src, "ok.ndjson"), ['{"level":"A"}'])
    write_lines(os.path.join(src, "long.ndjson"), ['{"level":"B"}', '{"msg":"%s"}' % ("y" * 200)])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("long", "path", {"root": src})
    res = {r.file_name: r for r in L.load_files(store, spec, ["ok.ndjson", "long.ndjson"])}
    assert res["ok.ndjson"].rows_inserted == 1 and not res["ok.ndjson"].error
    assert res["long.ndjson"].error
    assert [r["level"] for r in store.table(spec).collect()] == ["A"]
    assert [r["file_name"] for r in store.manifest(spec.id).collect()] == ["ok.ndjson"]


def test_interrupted_load_is_undone(spark, workdir):
    src = os.path.join(workdir, "bucket")
    write_lines(os.path.join(src, "a.ndjson"), ['{"level":"A"}'])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("crash", "path", {"root": src})
    orig = store.append_manifest
    store.append_manifest = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost"))
    L.sync_source(store, spec)
    store.append_manifest = orig
    # The isolation path undid the published rows; nothing is marked, so the next poll reloads.
    assert store.table(spec).count() == 0
    assert L.sync_source(store, spec) == 1
    assert store.table(spec).count() == 1


def test_listing_prefix_age_and_loaded_flag(sample_store):
    store, spec, src, _ = sample_store
    write_lines(os.path.join(src, "logs", "c.ndjson"), ['{"level":"C"}'])
    write_lines(os.path.join(src, "other", "d.ndjson"), ['{"level":"D"}'])
    flags = {r["name"]: r["loaded"] for r in L.listing_with_flag(store, spec).collect()}
    assert flags == {"logs/a.ndjson": True, "logs/c.ndjson": False}
    assert [r["name"] for r in L.pending_files(store, spec).collect()] == ["logs/c.ndjson"]
    over = {r["name"] for r in L.listing_with_flag(store, spec, prefix="").collect()}
    assert "other/d.ndjson" in over
    old = os.path.join(src, "logs", "c.ndjson")
    os.utime(old, (0, 0))
    spec.load_days_back = 3
    assert L.pending_files(store, spec).count() == 0


def test_schema_evolution_reads_null_for_old_rows(sample_store):
    from tidelog.spec import Field
    store, spec, src, _ = sample_store
    store.update_source(spec.id, fields=list(spec.fields) + [Field("user", ("user",))], prefix="logs/")
    write_lines(os.path.join(src, "logs", "e.ndjson"), ['{"level":"E","user":"u1"}'])
    L.sync_source(store, spec.id)
    vals = {r["source_file"]: r["user"] for r in store.table(spec.id).select("source_file", "user").collect()}
    assert vals["logs/e.ndjson"] == "u1" and vals["logs/a.ndjson"] is None


def test_drop_source(sample_store):
    import pytest
    from tidelog.catalog import SourceNotFound
    store, spec, _, _ = sample_store
    store.delete_source(spec.id)
    with pytest.raises(SourceNotFound):
        store.table(spec)
    assert not fs.exists(store.spark, store.table_dir(spec.id))


def test_manifest_compaction_keeps_latest_rows(sample_store):
    from tidelog.catalog import compact_manifest
    from datetime import datetime
    store, spec, _, _ = sample_store
    store.append_manifest(spec.id, [(spec.id, "logs/a.ndjson", datetime(2030, 1, 1), 9)])
    assert compact_manifest(store, spec.id, min_files=1)
    rows = store.manifest_raw(spec.id).collect()
    assert [(r["file_name"], r["rows_ingested"]) for r in rows] == [("logs/a.ndjson", 9)]


def test_explicit_list_accepts_zero_byte_object(spark, workdir):
    src = os.path.join(workdir, "bucket")
    os.makedirs(src)
    open(os.path.join(src, "empty.ndjson"), "w").close()
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("zero", "path", {"root": src})
    res = L.load_files(store, spec, ["empty.ndjson"])
    assert (res[0].rows_inserted, res[0].error) == (0, "")
    assert [r["file_name"] for r in store.manifest(spec.id).collect()] == ["empty.ndjson"]


def test_nanosecond_epoch_keeps_its_neighbours(spark, workdir):
    src = os.path.join(workdir, "bucket")
    write_lines(os.path.join(src, "n.ndjson"), ['{"time":1704240000123456789,"msg":"late"}', '{"time":1719835200,"msg":"fine"}'])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("nanos", "path", {"root": src})
    assert L.sync_source(store, spec) == 1
    rows = {r["msg"]: r["time"] for r in store.table(spec).select("msg", "time").collect()}
    assert rows["late"] is None and rows["fine"] is not None


def test_error_after_the_markers_does_not_load_twice(spark, workdir, monkeypatch):
    src = os.path.join(workdir, "bucket")
    for k in range(3):
        write_lines(os.path.join(src, f"{k}.ndjson"), ['{"msg":"a"}', '{"msg":"b"}'])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("twice", "path", {"root": src})
    landed = LogStore.append_manifest
    failed = []

    def append(self, sid, rows):
        landed(self, sid, rows)
        if not failed:
            failed.append(sid)
            raise OSError("injected after the markers landed")

    monkeypatch.setattr(LogStore, "append_manifest", append)
    res = L.load_files(store, spec, [f"{k}.ndjson" for k in range(3)])
    assert failed and [r.rows_inserted for r in res] == [2, 2, 2]
    assert store.table(spec).count() == 6


def test_failed_move_is_an_error(spark, workdir):
    import pytest

    class Refuses:
        def rename(self, src, dst):
            return False

    h = fs.Handle(spark, workdir)
    h.fs = Refuses()
    with pytest.raises(OSError, match="can't move"):
        h.rename(os.path.join(workdir, "a"), os.path.join(workdir, "b"))


def test_byte_order_mark_hides_the_first_line(spark, workdir):
    """The mark stands before the first value: that line is skipped, and a blank one counts as a line that isn't JSON."""
    src = os.path.join(workdir, "bucket")
    os.makedirs(src)
    body = {"marked": b'\xef\xbb\xbf{"msg":"a"}\n{"msg":"b"}\n', "open": b'\xef\xbb\xbf{"msg":"a"}\n{"msg":"b"}', "blank": b'\xef\xbb\xbf\n{"msg":"b"}\n',
            "plain": b'{"msg":"a"}\n{"msg":"\xef\xbb\xbf"}\n', "later": b'{"msg":"a"}\n\xef\xbb\xbf{"msg":"b"}'}
    for name, text in body.items():
        with open(f"{src}/{name}.ndjson", "wb") as f:
            f.write(text)
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("marks", "path", {"root": src})
    got = {s.file_name[:-7]: (s.rows_inserted, s.lines_skipped) for s in L.sync_summaries(store, spec)}
    assert got == {"marked": (1, 1), "open": (1, 1), "blank": (1, 1), "plain": (2, 0), "later": (1, 1)}
    assert {(r["source_file"], r["source_line"]) for r in store.table(spec).where("source_file like 'marked%'").collect()} == {("marked.ndjson", 2)}


def test_long_listings_are_grouped_by_spark(spark, workdir, monkeypatch):
    """Groups keep every file once, in name order, within the bounds, and the rows load as before."""
    src = os.path.join(workdir, "bucket")
    for k in range(23):
        write_lines(os.path.join(src, f"f{k:03d}.ndjson"), ['{"msg":"m%d"}' % k] * (k + 1))
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("many", "path", {"root": src})
    monkeypatch.setattr(L, "GROUP_MAX_FILES", 5)
    groups = list(L.planned_groups(store, spec, L.pending_files(store, spec)))
    assert [n for g in groups for n, _, _ in g] == [f"f{k:03d}.ndjson" for k in range(23)] and 5 <= len(groups) and max(map(len, groups)) <= 6
    done = L.sync_summaries(store, spec)
    assert {s.file_name: s.rows_inserted for s in done} == {f"f{k:03d}.ndjson": k + 1 for k in range(23)}
