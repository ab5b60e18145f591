"""Helpers shared by the training-data operators: text columns, shared folder, stored tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the only white space that separates words: blank and tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch: texts may be very long, and a batch is held whole by a Python worker.
ARROW_ROWS = "1000"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (tests on one machine) a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="tidelog-llm-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table; batches for Python workers are kept small, as texts may be long.

    Workers import this package; where it isn't installed (or given by ``--py-files``) they find it beside the driver's.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``embeddings`` table, with small batches like those of ``documents``."""
    documents(spark, sf_dir)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, null text as empty: extra columns can't clash with what an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_words: dict[str, dict] = {}


def word_cache(owner: str) -> dict:
    """What a Python worker keeps about words for one operator.  Workers outlive tasks and operators: the cache of an operator
    goes as soon as another one asks for its own, so that they never add up."""
    if owner not in _words:
        _words.clear()
        _words[owner] = {}
    return _words[owner]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor
