"""Token-id files (operator 6): documents in id order, coded by the adaptive range coder, written and read by Spark.

File format: Parquet rows of one segment each: ``part`` and ``segment`` (their order is that of the documents),
``n_ids``, ``doc_ids`` and ``doc_lengths`` (documents whole, in order), ``payload`` (see ``range_coder``: blocks
that decode independently, each with its checksum).  A segment closes at ``SEGMENT`` ids or at the end of its
partition; a document never spans segments, so one decodes without any other.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import shared_dir, texts
from tidelog.llm.library_ids import library_ids
from tidelog.llm.range_coder import BLOCK, LANES, decode_segment, encode_segment

SEGMENT = BLOCK * LANES
ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
SCHEMA = "part int, segment int, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def write_ids(docs: DataFrame, vocab_path: str, path: str, end_id: int = 2) -> None:
    """Encode every text, append ``end_id``, and write the files at ``path`` in ascending doc_id order.

    Null or empty text: the end id alone.  Rows of one doc_id follow in the order of a hash of their text; a null
    doc_id comes first.  An empty table gives files without segments.  Other columns are not read.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        lib, part, segment = library_ids(vocab_path, True), TaskContext.get().partitionId(), 0
        docs_in, lengths, held, size = [], [], [], 0

        def close():
            nonlocal segment, size
            row = (part, segment, size, docs_in[:], lengths[:], encode_segment(np.frombuffer(b"".join(held), "<u4")))
            segment, size = segment + 1, 0
            for x in (docs_in, lengths, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), lib.bytes_of(batch.column("text")), strict=True):
                ids += end
                docs_in.append(doc)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= SEGMENT:
                    yield close()
        if size:
            yield close()

    order = ["doc_id", "tie"]
    (texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
     .drop("tie").mapInArrow(run, SCHEMA).write.parquet(path))


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, segment_start: ids of all segments before it."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids_in_part"))
    # One row for each written partition.
    parts = parts.select("part", (F.sum("ids_in_part").over(Window.orderBy("part")) - F.col("ids_in_part")).alias("part_start"))
    inside = (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids"))
    return (segments.select("part", "segment", inside.alias("inside")).join(parts, "part")
            .select("part", "segment", (F.col("inside") + F.col("part_start")).alias("segment_start")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, doc_id, inside (ids before it in its segment), ids (binary, little-endian unsigned 32-bit).

    Raises where the checksum of a block doesn't hold.
    """

    fields = ["part", "segment", "doc_id", "inside", "ids"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["payload"])
                lengths = np.asarray(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                if len(ids) != row["n_ids"] or ends[-1] != row["n_ids"]:
                    raise ValueError("document lengths don't add up to the ids of the segment")
                data, first = ids.tobytes(), (ends - lengths).tolist()
                for k in range(0, len(first), 1000):  # few documents at a time back to Spark
                    own = [data[4 * a:4 * b] for a, b in zip(first[k:k + 1000], ends[k:k + 1000].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(own), pa.int32()), pa.array([row["segment"]] * len(own), pa.int32()),
                                                      pa.array(row["doc_ids"][k:k + 1000], pa.int64()), pa.array(first[k:k + 1000], pa.int64()), pa.array(own, pa.binary())], fields)

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "part int, segment int, doc_id long, inside long, ids binary")


def round_trip(docs: DataFrame, vocab_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written in the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, vocab_path, path, end_id)
    return digests(spark, path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files at ``path``."""
    narrow = read_ids(spark, path).select("part", "segment", "doc_id", "inside", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return narrow.join(segment_starts(spark, path), ["part", "segment"]).select("doc_id", (F.col("segment_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
