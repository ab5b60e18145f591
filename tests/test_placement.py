"""Placement and time index, text filters, pick list, time-ordered compaction, group planning."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from log_samples import write_lines
from tidelog.catalog import LogStore, forget_files
from tidelog.operators import load as L
from tidelog.operators import ngrams, pages, picklist, placement
from tidelog.operators import partitions as P
from tidelog.operators import retention as R
from tidelog.operators import search as Q


def lines_of(k, n=40):
    rnd = random.Random(k)
    out = []
    for i in range(n):
        t = datetime(2024, 1, 1) + timedelta(days=rnd.randrange(4), seconds=rnd.randrange(200))
        time = "" if rnd.random() < 0.1 else '"time":"%s",' % t.isoformat(sep=" ")
        out.append('{%s"level":"%s","msg":"word%d caf\\u00e9 \\"q\\" %s","accession":"A%d"}' % (time, rnd.choice(["INFO", "ERROR"]), rnd.randrange(40), "x" * rnd.randrange(4), k * 100 + i))
    return out


@pytest.fixture
def store_spec(spark, workdir):
    src = os.path.join(workdir, "bucket")
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("placed", "path", {"root": src})
    for k in range(3):
        write_lines(os.path.join(src, f"f{k}.ndjson"), lines_of(k))
        L.sync_source(store, spec)
    return store, spec, src


def test_first_load_reads_no_data_file(store_spec, monkeypatch):
    """Names never seen: the placement table alone answers, and no partition is opened or rewritten."""
    store, spec, src = store_spec
    opened = []
    real = P.read_parts
    monkeypatch.setattr(P, "read_parts", lambda *a: opened.append(a[2]) or real(*a))
    write_lines(os.path.join(src, "f9.ndjson"), lines_of(9))
    assert L.sync_source(store, spec) == 1 and opened == []
    rows = store.table(spec).count()
    forget_files(store, spec.id, ["f1.ndjson"])
    held = {r[0] for r in store.table(spec).where("source_file = 'f1.ndjson'").select("event_date").distinct().collect()}
    write_lines(os.path.join(src, "f1.ndjson"), lines_of(1, 20))
    assert L.sync_source(store, spec) == 1 and store.table(spec).count() == rows - 20
    assert {p for parts in opened for p in parts} == {placement.directory(d) for d in held}


def test_index_agrees_with_the_table(store_spec):
    store, spec, src = store_spec

    def agree():
        t = store.table(spec)
        real = t.groupBy("event_date", F.col("_metadata.file_name").alias("f")).agg(F.min("time"), F.max("time"), F.count(F.lit(1)), F.count_if(F.col("time").isNull()))
        want = {tuple(r)[:2]: tuple(r)[2:] for r in real.collect()}
        live = placement.Live(store, spec)
        got = {tuple(r)[:2]: tuple(r)[2:] for r in placement.file_times(store, spec).collect() if live(r["event_date"], r["data_file"])}
        assert got == want and len(want) > 1

    agree()
    R.compact(store, spec)
    agree()
    R.delete_older_than(store, spec, datetime(2024, 1, 3, 0, 1))
    agree()
    assert placement.compact_index(store, spec, 1)
    agree()
    assert placement.file_times(store, spec).count() == len(set(map(tuple, store.table(spec).select("event_date", "_metadata.file_name").distinct().collect())))
    for name in ("placement", "file_times"):  # a table from before the index
        D = f"{store.table_dir(spec.id)}/{name}"
        from tidelog.sources import fs
        fs.delete(store.spark, D, True)
    placement.ensure(store, spec)
    agree()


def _plain(store, spec, **kw):
    return [tuple(r) for r in Q.filtered(store.table(spec), spec, **kw).orderBy(*Q.order()).select(*Q.result_columns(spec)).collect()]


def test_pages_equal_a_full_sort_and_read_no_file_twice(store_spec):
    store, spec, _ = store_spec
    for kw in ({}, {"level": "ERROR"}, {"text": "word7 "}, {"fields": {"accession": "A11"}}, {"time_from": datetime(2024, 1, 2), "time_to": datetime(2024, 1, 3, 0, 1)},
               {"text": "nowhere"}):
        want = _plain(store, spec, **kw)
        for offset, size in ((0, 10), (25, 7), (len(want), 5)):
            page = pages.page(store, spec, offset, size, **kw)
            assert [tuple(r) for r in page.rows] == want[offset:offset + size] and page.has_more == (len(want) > offset + size)
            read = [f for b in page.blocks for f in b]
            assert len(read) == len(set(read))
        cursor, seen = None, []
        while True:
            page = pages.page(store, spec, size=33, cursor=cursor, **kw)
            seen += [tuple(r) for r in page.rows]
            if not page.has_more:
                break
            last = page.rows[-1]
            cursor = last["time"], last["source_file"], last["source_line"]
        assert seen == want
    R.compact(store, spec)  # one file for each date
    assert len(pages.page(store, spec, size=1).blocks) == 1 and len(P.partitions(store, spec.id)) > 3


def test_text_filter_skips_files_without_losing_rows(store_spec):
    store, spec, src = store_spec
    ngrams.enable(store, spec)
    write_lines(os.path.join(src, "late.ndjson"), ['{"time":"2024-01-09 01:00:00","level":"INFO","msg":"only h\\u00e9re \\"it\\" is: unicorn_7","accession":"Z"}', '{"msg":"日本語テキスト"}'])
    assert L.sync_source(store, spec) == 1
    assert {r[0] for r in store.table(spec).where("msg like '%unicorn%'").select("msg").collect()} == {'only hére "it" is: unicorn_7'}
    for kw in ({"text": "unicorn_7"}, {"fields": {"msg": 'hére "it"'}}, {"text": "word3"}, {"text": "日本語テ"}, {"text": "abc"}, {"fields": {"msg": "café"}}):
        assert [tuple(r) for r in pages.page(store, spec, size=500, **kw).rows] == _plain(store, spec, **kw)
    files = store.table(spec).select("event_date", "_metadata.file_name").distinct().count()
    out = ngrams.files_without(store, spec, ["unicorn_7"])
    assert out.count() == files - 1
    assert len([f for b in pages.page(store, spec, text="unicorn_7").blocks for f in b]) == 1
    assert ngrams.files_without(store, spec, ngrams.needles(spec, {"nope": "unicorn_7"}, "abc")) is None
    R.compact(store, spec)
    before = ngrams.table(store, spec).count()
    assert placement.compact_index(store, spec, 1) and 0 < ngrams.table(store, spec).count() < before
    assert ngrams.files_without(store, spec, ["unicorn_7"]).count() == store.table(spec).select("event_date", "_metadata.file_name").distinct().count() - 1
    assert [tuple(r) for r in pages.page(store, spec, text="unicorn_7").rows] == _plain(store, spec, text="unicorn_7")


def test_pick_list_matches_contains(spark, store_spec):
    store, spec, _ = store_spec
    t = store.table(spec)
    raws = {(r["source_file"], r["source_line"]): r["raw"] for r in t.collect()}
    for values in (["A10", "A205", "word7", "word39", "nowhere", None, ""], ["x", "q", "A1"], ["日"], [], ["é", "A" * 50] + [f"A{k}" for k in range(300)]):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        want = {(*k, v) for k, raw in raws.items() for v in values if v and v in raw}
        assert {tuple(r) for r in picklist.matches(t, df).collect()} == want
        got = picklist.containing_any(t, df)
        assert got.columns == t.columns and sorted((r["source_file"], r["source_line"]) for r in got.collect()) == sorted({w[:2] for w in want})


@pytest.mark.parametrize("burst", [False, True])
def test_compacted_files_do_not_overlap_in_time(spark, workdir, burst):
    src = os.path.join(workdir, "bucket")
    rnd = random.Random(4)
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("big", "path", {"root": src})
    for k in range(3):
        def line():
            day, hour, minute = (1, 5, 0) if burst else (rnd.randrange(1, 3), rnd.randrange(24), rnd.randrange(60))
            time = "" if rnd.random() < 0.05 else '"time":"2024-02-0%d %02d:%02d:00",' % (day, hour, minute)
            return '{%s"msg":"%s"}' % (time, os.urandom(30).hex())

        write_lines(os.path.join(src, f"f{k}.ndjson"), [line() for _ in range(1500)])
    L.sync_source(store, spec)
    before = sorted(map(tuple, store.table(spec).collect()), key=str)
    R.compact(store, spec, file_bytes=40_000)
    assert sorted(map(tuple, store.table(spec).collect()), key=str) == before
    found = {r["event_date"]: (r["n_files"], r["n_overlaps"]) for r in P.overlaps(store, spec).collect()}
    assert all(n == 0 for _, n in found.values()) and max(n for n, _ in found.values()) > 3
    names = {p: sorted(n for n, _ in f) for p, f in P.file_stats(store, spec.id).items()}
    R.compact(store, spec, only_fragmented=True, file_bytes=40_000)
    assert {p: sorted(n for n, _ in f) for p, f in P.file_stats(store, spec.id).items()} == names


def test_sizes_follow_the_files(store_spec):
    store, spec, _ = store_spec
    real = {p: (len(f), sum(s for _, s in f)) for p, f in P.file_stats(store, spec.id).items()}
    assert {placement.directory(r["event_date"]): (r["n_files"], r["size_bytes"]) for r in store.sizes_df().collect()} == real
    empty = store.create_source("Other", "path", {"root": "/none"})
    sizes = {r["id"]: r["size_bytes"] for r in store.sources_df().collect()}
    assert sizes == {spec.id: store.size_bytes(spec.id), empty.id: 0} and sizes[spec.id] > 0
