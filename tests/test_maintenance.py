import os
from datetime import datetime, timedelta

from log_samples import write_lines
from tidelog.catalog import LogStore
from tidelog.operators import load as L
from tidelog.operators import retention as R
from tidelog.plans.maintenance import due_sources, run_maintenance


def test_due_selection_and_pass_marks_polled(spark, workdir):
    src = os.path.join(workdir, "bucket")
    write_lines(os.path.join(src, "a.ndjson"), ['{"time":"2024-01-01 00:00:00","level":"A"}'])
    store = LogStore(spark, os.path.join(workdir, "store"))
    a = store.create_source("auto", "path", {"root": src}, auto_load=True, poll_minutes=10)
    store.create_source("idle", "path", {"root": src})
    b = store.create_source("broken", "path", {"root": src + "/missing"}, auto_load=True, retention_days=1)
    now = datetime(2024, 1, 2)
    assert sorted(r["id"] for r in due_sources(store.sources_df(), now).collect()) == ["auto", "broken"]
    reps = {r.source_id: r for r in run_maintenance(store, now)}
    assert reps["auto"].files_loaded == 1
    assert store.get("broken").last_polled_at == now and store.get("auto").last_polled_at == now
    assert due_sources(store.sources_df(), now + timedelta(minutes=9)).count() == 0
    assert due_sources(store.sources_df(), now + timedelta(minutes=10)).count() == 1


def test_migrate_legacy_split(spark, workdir):
    from pyspark.sql import functions as F
    src = os.path.join(workdir, "bucket")
    store = LogStore(spark, os.path.join(workdir, "store"))
    store.create_source("one", "path", {"root": src})
    store.create_source("two", "path", {"root": src})
    rows = spark.createDataFrame(
        [("one", '{"level":"A"}', "f1", 1, datetime(2024, 1, 1), None, "A", None, None, None, None, "h1"),
         ("two", '{"level":"B"}', "f2", 1, datetime(2024, 1, 1), None, "B", None, None, None, None, "h2"),
         ("two", '{"level":"C"}', "f2", 2, datetime(2024, 1, 1), None, "C", None, None, None, None, "h3")],
        "source_id string, raw string, source_file string, source_line int, ingested_at timestamp_ntz, "
        "time timestamp_ntz, level string, msg string, topic string, accession string, study_uid string, "
        "file_hash string")
    man = spark.createDataFrame([("one", "f1", datetime(2024, 1, 1), 1), ("two", "f2", datetime(2024, 1, 1), 2)],
                                "source_id string, file_name string, ingested_at timestamp_ntz, rows_ingested int")
    out = R.migrate_legacy(store, rows, man)
    assert out == {"one": 1, "two": 2}
    assert "file_hash" not in store.table("two").columns
    assert store.manifest("two").collect()[0]["rows_ingested"] == 2
