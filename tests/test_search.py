from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidelog.operators import search as Q


def test_filters_on_sample(sample_store):
    store, spec, _, _ = sample_store
    t = store.table(spec)
    n = lambda **kw: len(Q.search(t, spec, **kw).rows)
    assert n(level="ALARM") == 1
    assert n(fields={"accession": "-11"}) == 1
    assert n(fields={"msg": "pump st"}) == 2
    assert n(fields={"msg": "pump%"}) == 0
    assert n(text="40%bar") == 0
    assert n(text="40_bar") == 1
    assert n(fields={"nope": "x", "level": "ALARM", "time": "2024", "msg": ""}) == 4
    assert n(time_from=datetime(2024, 6, 30, 8, 15)) == 2
    assert n(time_to=datetime(2024, 6, 30, 8, 15)) == 2
    assert n(level="alarm") == 0


def test_result_rows_and_order(sample_store):
    store, spec, _, _ = sample_store
    res = Q.search(store.table(spec), spec)
    assert not res.has_more
    assert [r["source_line"] for r in res.rows] == [3, 4, 5, 2]
    row4 = res.rows[1]
    assert row4["fields"] == {"msg": "pump stalled", "topic": "plant-7", "study_uid": "run_42"}
    assert not {"time", "level"} & set(row4["fields"])
    assert res.rows[3]["fields"] == {}


def test_levels_raw_and_detail(sample_store):
    store, spec, _, _ = sample_store
    t = store.table(spec)
    assert [r["level"] for r in Q.distinct_levels(t).collect()] == ["ALARM", "DEBUG", "NOTICE"]
    assert Q.raw_line(t, "logs/a.ndjson", 3).startswith('{"time":1719835200')
    with pytest.raises(KeyError):
        Q.raw_line(t, "logs/a.ndjson", 1)
    kv = {(r["source_line"], r["key"]): r["value"] for r in Q.detail_kv(t).collect()}
    assert kv[(3, "time")] == "1719835200" and kv[(4, ":topic")] == "plant-7"
    assert Q.filtered(t, spec).where(Q.contains_any(["plant-7", "Q-118"])).count() == 2


def test_end_of_day_bound():
    d = date(2024, 7, 25)
    assert Q.end_of_day_bound(d, end_of_day=True) == datetime(2024, 7, 25, 23, 59, 59)
    assert Q.end_of_day_bound(d, hour=9) == datetime(2024, 7, 25, 9, 0, 0)
    assert Q.end_of_day_bound(d, minute=5, end_of_day=True) == datetime(2024, 7, 25, 23, 5, 59)


def test_keyset_pages_equal_offset_pages(spark, workdir):
    """Ties on time and NULL times: walking by cursor gives the offset pages, page by page."""
    import os
    from log_samples import write_lines
    from tidelog.catalog import LogStore
    from tidelog.operators import load as L
    src = os.path.join(workdir, "bucket")
    for f in range(3):
        lines = []
        for i in range(250):
            if i % 7 == 0:
                lines.append('{"level":"N","msg":"%d"}' % i)
            else:
                lines.append('{"time":"2024-01-%02d 00:00:%02d","level":"L"}' % (1 + i % 3, i % 5))
        write_lines(os.path.join(src, f"p{f}.ndjson"), lines)
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("paging", "path", {"root": src})
    L.sync_source(store, spec)
    t = store.table(spec)
    cursor, seen, k = None, 0, 0
    while True:
        ks = Q.keyset_page(t, spec, cursor, size=50).collect()
        off = Q.page(t, spec, offset=k * 50, size=50).collect()
        assert [(r["source_file"], r["source_line"]) for r in ks] == [(r["source_file"], r["source_line"]) for r in off]
        if len(ks) <= 50:
            break
        last = ks[49]
        cursor = (last["time"], last["source_file"], last["source_line"])
        k += 1
    assert k == 14
