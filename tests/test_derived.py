"""Sources that are loaded in part: the names come from Spark's plan of load groups, never as one list of the driver."""
import os
from datetime import datetime

from pyspark.sql import functions as F

from tidelog.operators import load as L
from tidelog.plans import derived as D


def test_part_of_a_source_is_loaded_in_planned_groups(spark, workdir, monkeypatch):
    rows = [(i, i % 7, "O", datetime(1995, 1 + i % 4, 1), "1-URGENT") for i in range(40)]
    columns = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, columns).write.parquet(os.path.join(workdir, "orders.parquet"))

    def whole_list(*_):
        raise AssertionError("the whole list of names is in the driver")

    monkeypatch.setattr(L, "load_file_list", whole_list)
    monkeypatch.setattr(L, "GROUP_MAX_FILES", 1)  # several groups, numbered by Spark
    odd = F.substring("name", 13, 2).cast("int") % 2 == 1
    store, spec, _ = D.build_source(spark, "orders", workdir, names_filter=odd, cache=False)
    held = {r["source_file"]: r["n"] for r in store.table(spec).groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held == {f"orders/1995-0{m}/part-0.ndjson": 10 for m in (1, 3)}
    assert sorted(r["name"] for r in L.pending_files(store, spec).collect()) == [f"orders/1995-0{m}/part-0.ndjson" for m in (2, 4)]
