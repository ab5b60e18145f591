"""Object listing under a source root (O-1, O-2, O-3, O-34, O-35).

The listing is a DataFrame from the `binaryFile` source with the content column pruned, so only
file metadata is read.  Note: Spark's file listing skips names that start with '_' or '.'.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import fs


def list_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(name, path, size, modified) of every object under root whose relative name starts with
    `prefix` (a string prefix, not a directory)."""
    root_q = fs.qualify(spark, root).rstrip("/")
    schema = "path string, modificationTime timestamp, length bigint"
    if not fs.exists(spark, root_q):
        return spark.createDataFrame([], schema).select(
            F.lit(None).cast("string").alias("name"), "path", F.col("length").alias("size"),
            F.col("modificationTime").alias("modified")).limit(0)
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .load(root_q).select("path", "modificationTime", "length"))
    start = len(root_q) + 2
    name = F.substring(F.col("path"), start, 1 << 30)
    out = df.select(name.alias("name"), "path", F.col("length").alias("size"),
                    F.col("modificationTime").alias("modified"))
    if prefix:
        out = out.where(F.col("name").startswith(prefix))
    return out


def filter_by_age(listing: DataFrame, load_days_back: int, now: datetime | None = None) -> DataFrame:
    """Keep objects modified at or after now - N days; N <= 0 keeps all (O-2)."""
    if load_days_back <= 0:
        return listing
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    cutoff = now - timedelta(days=load_days_back)
    # modificationTime is an instant; compare as microseconds since the epoch (UTC).
    cutoff_us = int((cutoff - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    return listing.where(F.unix_micros(F.col("modified")) >= F.lit(cutoff_us))


def with_loaded_flag(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listing plus `loaded` = a manifest row exists for the name (O-3)."""
    m = manifest.select(F.col("file_name").alias("name")).distinct().withColumn("_m", F.lit(True))
    return listing.join(m, "name", "left").select(
        *listing.columns, F.coalesce(F.col("_m"), F.lit(False)).alias("loaded"))


def new_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects never loaded (O-35): anti-join on the name; dedup is by name only (T15)."""
    m = manifest.select(F.col("file_name").alias("name"))
    return listing.join(m, "name", "left_anti")
