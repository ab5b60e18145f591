"""What must not grow with the tables: sides that are broadcast, tasks of a load, files of a task, rows that a deep page holds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from log_samples import write_lines
from tidelog.catalog import MANIFEST_SCHEMA, LogStore, local_frame
from tidelog.operators import load as L
from tidelog.operators import partitions as P
from tidelog.operators import picklist
from tidelog.operators import retention as R
from tidelog.operators import search as Q


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("held", [picklist.HELD_BYTES, 0])
def test_pick_list_sends_no_exploded_rows_around(spark, monkeypatch, held):
    """Lists held by every task, and longer ones: the texts a row by row search finds, the rows' grams never broadcast."""
    monkeypatch.setattr(picklist, "HELD_BYTES", held)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcé日𝄞 1") for _ in range(rnd.randrange(60))) for _ in range(150)] + ["ab" * 400, "", None]
    values = sorted({t[a:a + n] for t in texts if t for n in (1, 2, 3, 4, 5, 8, 9, 20) for a in (rnd.randrange(len(t)),)}) + ["nowhere", "", None]
    rows = spark.createDataFrame([(f"f{i % 3}", i, t) for i, t in enumerate(texts)], "source_file string, source_line int, raw string")
    listed = spark.createDataFrame([(v,) for v in values], "v string")
    found = picklist.matches(rows, listed)
    assert "BuildLeft" not in plan_of(found)
    want = {(f"f{i % 3}", i, v) for i, t in enumerate(texts) for v in values if t and v and v in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    held_rows = picklist.containing_any(rows, listed)
    assert plan_of(held_rows).startswith("SortMergeJoin") and "BuildLeft" not in plan_of(held_rows)
    assert {r["source_line"] for r in held_rows.collect()} == {i for _, i, _ in want}


def _shuffled(plan):
    """Rows that each shuffle of an executed plan has written, those for broadcasts left out."""
    name = plan.getClass().getSimpleName()
    if name in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "ResultQueryStageExec"):
        return _shuffled(plan.executedPlan() if name.startswith("Adaptive") else plan.plan())
    own = [plan.metrics().get("shuffleRecordsWritten").get().value()] if name == "ShuffleExchangeExec" else []
    return own + [n for k in range(plan.children().size()) for n in _shuffled(plan.children().apply(k))]


def test_a_long_pick_list_shuffles_only_what_may_match(spark, monkeypatch):
    """A list of more values than a small filter tells apart: of the rows' grams those that match are shuffled, and hardly another."""
    monkeypatch.setattr(picklist, "HELD_BYTES", 0)
    rnd, n = random.Random(9), 300_000
    values = spark.range(n).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("v")).union(
        spark.range(n).where("id < 500").select(F.concat(F.lit("S"), (F.col("id") + 1000).cast("string"))))
    texts = ["".join(rnd.choice("abcdefgh 0123456789") for _ in range(80)) + ("v000000123" if k % 50 == 0 else " S1234") for k in range(200)]
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "source_file string, source_line int, raw string")
    found = picklist.matches(rows, values)
    assert sorted((r["source_line"], r["value"]) for r in found.collect()) == [(k, "v000000123" if k % 50 == 0 else "S1234") for k in range(200)]
    counts = _shuffled(found._jdf.queryExecution().executedPlan())
    assert len(counts) == 3 and n + 500 < sum(counts) < n + 500 + 2 * 200 + 300


def _source(spark, workdir, lines, files=1, **kw):
    src = os.path.join(workdir, "bucket")
    for k in range(files):
        write_lines(os.path.join(src, f"f{k:03d}.ndjson"), lines)
    store = LogStore(spark, os.path.join(workdir, "store"))
    return store, store.create_source("scale", "path", {"root": src}, **kw)


def test_short_splits_share_tasks(spark, workdir, monkeypatch):
    """Splits far below their cost of opening get their line numbers in a few tasks, not in one task each."""
    store, spec = _source(spark, workdir, ['{"level":"L","msg":"%s"}' % ("x" * 80)] * 100, files=30)
    tasks, real = [], L.N.split_table
    monkeypatch.setattr(L.N, "split_table", lambda lines: tasks.append(lines.rdd.getNumPartitions()) or real(lines))
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert L.sync_source(store, spec) == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert tasks[0] <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
    numbers = store.table(spec).groupBy("source_file").agg(F.sort_array(F.collect_list("source_line")).alias("n"))
    assert [r["n"] for r in numbers.collect()] == [list(range(1, 101))] * 30


@pytest.mark.parametrize("burst", [False, True])
def test_many_files_of_few_tasks(spark, workdir, monkeypatch, burst):
    """More files than tasks: rows stay, a date's files follow each other, and a task's range is cut by rows."""
    rnd = random.Random(3)
    lines = ['{"time":"2024-01-0%d 00:%02d:00","msg":"%s"}' % (1 if burst else 1 + rnd.randrange(3), 0 if burst else rnd.randrange(60), rnd.random()) for _ in range(6000)]
    store, spec = _source(spark, workdir, lines)
    L.sync_source(store, spec)
    before = sorted(map(tuple, store.table(spec).select("time", "source_line", "raw").collect()))
    monkeypatch.setattr(P, "MOST_TASKS", 6)
    monkeypatch.setattr(P, "MOST_RANGES", 4)
    wanted = sum(R._files_wanted(f, 4096) for f in P.file_stats(store, spec.id).values())
    R.compact(store, spec, file_bytes=4096)
    assert sorted(map(tuple, store.table(spec).select("time", "source_line", "raw").collect())) == before
    files = sum(map(len, P.file_stats(store, spec.id).values()))
    assert 24 < wanted and wanted / 2 < files < 2 * wanted
    assert P.overlaps(store, spec).agg(F.sum("n_overlaps")).collect()[0][0] == 0


def test_ranges_are_found_by_compiled_code(spark, workdir):
    """The range of a row is the number of bounds that aren't after it, rows without a time last, and no function over an array is interpreted for it."""
    rnd = random.Random(11)
    lines = ['{%s"msg":"%d"}' % ("" if rnd.random() < 0.2 else '"time":"2024-01-0%d 00:00:%02d",' % (1 + rnd.randrange(2), rnd.randrange(8)), k) for k in range(300)]
    store, spec = _source(spark, workdir, lines, files=2)
    L.sync_source(store, spec)
    rows = store.table(spec).where("event_date < '2025-01-01' or time is null").withColumn("event_date", F.lit("2024-01-01").cast("date"))
    many = {"event_date=2024-01-01": 21, "event_date=2024-01-02": 1}
    plan = P._by_time(rows, many)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "LogicalRDD" not in plan
    bounds = P._bounds(rows, {"event_date=2024-01-01": 21})
    (cuts,), = bounds.select("_bounds").collect()
    assert len(cuts) == 20
    key = lambda r: (r["time"] is None, r["time"] or 0, r["source_file"], r["source_line"])
    found = P._ranked(rows.withColumn("_date", F.col("event_date")).join(bounds, "_date"), 20).select("time", "source_file", "source_line", "_rank").collect()
    assert len(found) == 600 and all(r["_rank"] == sum(key(c) <= key(r) for c in cuts) for r in found)
    assert {r["_rank"] for r in P._ranked(rows.withColumn("_bounds", F.lit(None).cast("array<struct<untimed boolean, time timestamp_ntz, source_file string, source_line int>>")), 20).select("_rank").collect()} == {0}


def test_deep_page_leaves_out_newer_rows(spark, workdir, monkeypatch):
    """Beyond the offset that a top-k may hold: the rows of a full sort, also within equal times and among rows without a time."""
    rnd = random.Random(5)
    lines = ['{%s"msg":"%d"}' % ("" if rnd.random() < 0.1 else '"time":"2024-01-%02d 00:00:0%d",' % (1 + rnd.randrange(9), rnd.randrange(3)), k) for k in range(500)]
    store, spec = _source(spark, workdir, lines)
    L.sync_source(store, spec)
    want = [tuple(r) for r in store.table(spec).orderBy(*Q.order()).select(*Q.result_columns(spec)).collect()]
    monkeypatch.setattr(Q, "DEEP_OFFSET", 5)
    held, real = [], Q._without_newer
    monkeypatch.setattr(Q, "_without_newer", lambda *a: held.append(real(*a)) or held[-1])
    for offset in (6, 100, 249, 440, 470, 499, 600):
        assert [tuple(r) for r in Q.page(store.table(spec), spec, offset, 9).collect()] == want[offset:offset + 10]
    assert all(offset < 60 for _, offset in held[:4])


def test_filters_keep_every_gram(spark, workdir):
    """Bits of plain, escaped, short and non-ASCII lines are those of all their grams of characters."""
    from tidelog.operators import ngrams
    store, spec = _source(spark, workdir, ['{"msg":"plain %d"}' % k for k in range(50)] + ["{}", "null", '{"msg":"caf\\u00e9 \\"q\\""}', '{"msg":"日本語テキスト"}'])
    L.sync_source(store, spec)
    ngrams.enable(store, spec)
    plan = ngrams.filters(spec, store.table(spec))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # different bits first
    rows = store.table(spec).select("raw", "msg").collect()
    texts = {t for r in rows for t in (r["raw"], r["msg"] if "\\" in r["raw"] else None) if t}
    found = {t[k:k + 4] for t in texts for k in range(len(t) - 3)}
    bits = {(r["bucket"] - 1) * ngrams.BITMAP_BITS + 8 * i + j + 1 for r in ngrams.table(store, spec).where("bucket > 0").collect()
            for i, byte in enumerate(r["bits"]) for j in range(8) if byte >> j & 1}
    assert bits == {r[0] for r in spark.createDataFrame([(g,) for g in found], "g string").select(ngrams._bit(F.col("g"))).collect()}


def test_a_load_compiles_its_stages_and_sums_its_lines_up_by_hash(spark, workdir, monkeypatch):
    """Lines are counted without being sorted, no stage is a method that the JVM only interprets, and Python starts no worker for the names."""
    src = os.path.join(workdir, "bucket")
    write_lines(os.path.join(src, "a b.ndjson"), ['{"level":"A"}', "", '{"level":"B"}'])
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("quick", "path", {"root": src})
    seen, real = [], L.N.split_table

    def looked_at(lines):
        out = real(lines)
        seen.append((out._jdf.queryExecution().sparkPlan().toString(), int(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))))
        return out

    monkeypatch.setattr(L.N, "split_table", looked_at)
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    assert L.sync_source(store, spec) == 1
    (plan, limit), = seen
    assert "HashAggregate" in plan and "SortAggregate" not in plan and limit <= 8000
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
    assert sorted((r["source_file"], r["source_line"]) for r in store.table(spec).collect()) == [("a b.ndjson", 1), ("a b.ndjson", 3)]
    assert "LocalTableScan" in plan_of(local_frame(spark, [("quick", "a", None, None)], MANIFEST_SCHEMA))
