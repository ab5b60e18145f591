"""Session settings the library relies on, applied at run time to a caller's session."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Runtime SQL settings needed for correct results.
RUNTIME_CONF = {
    # JSON objects with a repeated key keep the last value (as a map decode does).
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Runtime re-planning: coalesce small shuffle partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dynamic partition overwrite: a rewrite touches only the partitions it produces.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    # A list of up to this many names reaches the Parquet reader as a list, which it tests against dictionaries and Bloom filters.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # Many given paths are listed by at most so many tasks; by default each path gets one.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "128",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    return spark


def kept_columns(build: Callable) -> Callable:
    """Columns that a function of plain arguments builds, made once for a JVM: each is several calls to it, thousands for every load."""
    @functools.lru_cache(maxsize=64)
    def made(_gateway, *args):
        return build(*args)

    return functools.wraps(build)(lambda *args: made(SparkContext._gateway, *args))


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for derived tables: the cluster's checkpoint dir.

    Only when the session names none (local tests) is a fresh local folder set.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="tidelog-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")
