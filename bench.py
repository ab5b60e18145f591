"""Benchmark: load, search and retention on NDJSON derived from the supplied tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line.  `value` is the sum of the timed steps in seconds; generating the NDJSON
objects from the parquet tables is not timed (it is fixture preparation, not engine work).
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog.catalog import LogStore  # noqa: E402
from tidelog.operators import load as L  # noqa: E402
from tidelog.operators import retention as R  # noqa: E402
from tidelog.operators import search as Q  # noqa: E402
from tidelog.operators import stats as S  # noqa: E402
from tidelog.plans import derived as D  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tidelog-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # Fixture preparation (untimed): NDJSON objects derived from events and lineitem.
    area = D.new_area(spark, "bench")
    ev_root, it_root = f"{area}/events", f"{area}/items"
    D.write_ndjson(spark, D._events_lines_named(spark, sf_dir), ev_root)
    D.write_ndjson(spark, D.lineitem_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet")), it_root)
    store = LogStore(spark, f"{area}/store")
    ev = store.create_source("events", "path", {"root": ev_root})
    it = store.create_source("items", "path", {"root": it_root}, partition_unit="month")

    timed("load_events", lambda: L.sync_source(store, ev))
    timed("load_items", lambda: L.sync_source(store, it))
    n_ev = store.table(ev).count()
    n_it = store.table(it).count()
    t_ev, t_it = store.table(ev), store.table(it)

    timed("unfiltered_page", lambda: Q.search(t_it, it))
    timed("needle_page", lambda: Q.search(t_it, it, text="line 7\""))
    timed("level_range_page", lambda: Q.search(t_ev, ev, level="ERROR", time_from=datetime(2024, 1, 10),
                                               time_to=datetime(2024, 1, 20, 23, 59, 59)))
    timed("deep_offset_page", lambda: Q.search(t_it, it, offset=n_it // 2))
    first = Q.search(t_it, it).rows
    cur = (first[-1]["time"], first[-1]["source_file"], first[-1]["source_line"])
    timed("keyset_page", lambda: Q.keyset_page(t_it, it, cur).collect())
    timed("distinct_levels", lambda: Q.distinct_levels(t_it).collect())
    timed("detail_kv", lambda: Q.detail_kv(t_ev).agg(F.count(F.lit(1))).collect())
    timed("oldest_cutoff", lambda: S.oldest_cutoff_micros(t_it, n_it, 0.33, it.partition_unit))
    timed("age_delete", lambda: R.delete_older_than(store, it, datetime(1996, 6, 17, 12)))
    timed("compaction", lambda: R.compact(store, it))

    load_secs = times["load_events"] + times["load_items"]
    out = {
        "metric": "tidelog_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": {"events": n_ev, "items": n_it},
        "load_rows_per_sec": round((n_ev + n_it) / load_secs, 1) if load_secs else None,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
