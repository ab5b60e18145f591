"""Counts, time bounds and the oldest-fraction cutoff (O-30 ... O-33, O-42).

The cutoff is an exact order statistic found without a global sort: a fixed number of equal-width
buckets over the current range is counted (map-side combined, so the shuffle carries at most
BUCKETS rows per task), the bucket holding the k-th row becomes the new range, and so on down to
one microsecond.  Only bucket counts reach the driver.  A burst of rows on one timestamp is one
bucket, so skew costs nothing (T31); after the first pass every scan is pruned by date partition
and Parquet min/max statistics on `time` / `ingested_at`.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import extract as X

# Fixed values that must match for identical behaviour.
MIN_TRIM_FRACTION = 0.10
MAX_TRIM_FRACTION = 0.50
TRIM_SLACK = 1.1

BUCKETS = 1 << 16
_EPOCH = datetime(1970, 1, 1)


def retention_key() -> Column:
    """Rows are aged by their time, or by load time when the line had none (T23)."""
    return F.coalesce(F.col("time"), F.col("ingested_at"))


def key_micros() -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), retention_key())


def micros_to_datetime(us: int) -> datetime | None:
    try:
        return _EPOCH + timedelta(microseconds=us)
    except OverflowError:
        return None


def micros_lit(us: int) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def row_count(table: DataFrame) -> int:
    """Row count (O-30): answered from Parquet footers, no column is decoded."""
    return table.count()


def time_bounds(table: DataFrame) -> DataFrame:
    """Min / max of time and of the retention key, and the row count (O-33)."""
    return table.agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"),
                     F.min(retention_key()).alias("min_key"), F.max(retention_key()).alias("max_key"),
                     F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def range_counts(table: DataFrame, unit: str = "day") -> DataFrame:
    """Rows per time bucket of the retention key (data distribution, O-33)."""
    return (table.groupBy(F.date_trunc(unit, retention_key()).alias("bucket"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))


def _range_filter(lo: int, hi: int, unit: str | None = None) -> Column:
    """key in [lo, hi) µs, in a form Parquet statistics and date partitions can prune.

    Without the table's partition unit the month bound is used: it is valid for day and month
    partitions alike (it only prunes less for daily ones)."""
    unit = unit or "month"
    pred = (key_micros() >= F.lit(lo)) & (key_micros() < F.lit(hi))
    lo_dt, hi_dt = micros_to_datetime(lo), micros_to_datetime(hi)
    if lo_dt is not None and hi_dt is not None:
        a, b = micros_lit(lo), micros_lit(hi)
        pushable = (((F.col("time") >= a) & (F.col("time") < b))
                    | (F.col("time").isNull() & (F.col("ingested_at") >= a) & (F.col("ingested_at") < b)))
        dates = (((F.col("event_date") >= F.lit(X.unit_start(lo_dt.date(), unit)))
                  & (F.col("event_date") <= F.lit(X.unit_start(hi_dt.date(), unit))))
                 | F.col("event_date").isNull())
        pred = pushable & dates & pred
    return pred


def kth_key_micros(table: DataFrame, k: int, buckets: int = BUCKETS, unit: str | None = None) -> int:
    """Exact k-th (0-based) smallest retention key, in µs since the epoch."""
    b = table.agg(F.min(key_micros()).alias("lo"), F.max(key_micros()).alias("hi")).collect()[0]
    if b["lo"] is None:
        raise ValueError("empty table")
    lo, hi = int(b["lo"]), int(b["hi"]) + 1
    while hi - lo > 1:
        width = -(-(hi - lo) // buckets)
        hist = (table.where(_range_filter(lo, hi, unit))
                .groupBy(F.floor((key_micros() - F.lit(lo)) / F.lit(width)).cast("bigint").alias("b"))
                .agg(F.count(F.lit(1)).alias("n")).collect())
        acc = 0
        for r in sorted(hist, key=lambda r: r["b"]):
            if acc + r["n"] > k:
                k -= acc
                lo = lo + r["b"] * width
                hi = min(hi, lo + width)
                break
            acc += r["n"]
        else:
            raise ValueError("order statistic out of range")
    return lo


def oldest_cutoff_micros(table: DataFrame, remaining: int, fraction: float, unit: str | None = None) -> int:
    """Cutoff that removes the oldest `fraction` of rows (O-32): value at offset
    clamp(floor(n * f), 1, n - 1) plus one microsecond, so rows tied with it go too."""
    k = int(remaining * fraction)
    k = max(k, 1)
    k = min(k, remaining - 1)
    return kth_key_micros(table, k, unit=unit) + 1


def trim_fraction(size_bytes: int, cap_bytes: int) -> float:
    """Share of rows a size-cap pass removes (O-42)."""
    return min(max((1 - cap_bytes / size_bytes) * TRIM_SLACK, MIN_TRIM_FRACTION), MAX_TRIM_FRACTION)


def trim_fraction_col(size: Column, cap: Column) -> Column:
    """Column form of `trim_fraction`, for a table of sizes."""
    raw = (F.lit(1.0) - cap / size) * F.lit(TRIM_SLACK)
    return F.least(F.greatest(raw, F.lit(MIN_TRIM_FRACTION)), F.lit(MAX_TRIM_FRACTION))
