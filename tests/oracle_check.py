"""Run registered queries on Spark and their SQL oracles on DuckDB, compare as multisets.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duck(sf_dir: str, sql: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def spark_rows(df):
    cols = df.columns
    out = []
    for r in df.toLocalIterator():
        out.append(tuple(r[c] for c in cols))
    return cols, out


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rs = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(rs, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir, names=None):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sc, sr = canon(*spark_rows(qs[name](spark, sf_dir)))
            t1 = time.time()
            if name not in orc:
                results[name] = ("rows-only", len(sr), round(t1 - t0, 2))
                continue
            dc, dr = canon(*duck(sf_dir, orc[name]))
            ok = sc == dc and sr == dr
            detail = ""
            if not ok:
                if sc != dc:
                    detail = f"cols {sc} vs {dc}"
                else:
                    diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
                    detail = f"rows {len(sr)} vs {len(dr)}; first diffs {diff}"
            results[name] = ("ok" if ok else "MISMATCH", len(sr), round(t1 - t0, 2), detail)
        except Exception as e:  # noqa: BLE001
            results[name] = ("ERROR", 0, round(time.time() - t0, 2), str(e).splitlines()[0][:300])
        print(name.ljust(24), *results[name], flush=True)
    return results


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "rows-only")]
    print("FAILED:", bad)
