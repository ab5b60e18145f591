"""A training corpus from raw documents: toxicity, quality, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its decisions take effect in what it
returns.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact, near, packing, quality, toxicity
from tidelog.llm.common import documents, labels, stored
from tidelog.llm.registry import vocabulary

SCORE = "_tl_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    scored = toxicity.with_score(docs, labels(spark, sf_dir), SCORE)
    return scored.filter(F.col(SCORE) < toxicity.THRESHOLD).drop(SCORE)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.with_score(docs, labels(spark, sf_dir), SCORE)
    return scored.filter(F.col(SCORE) >= quality.THRESHOLD).drop(SCORE)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays."""
    return exact.drop_repeats(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("packing", pack),
]

#: Classifiers and similarity links aren't expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each one's result written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
