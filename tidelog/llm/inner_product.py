"""Exact top-k search by inner product (operator 13): norm-bucketed retrieval over whole-number vectors.

Vectors are dealt by falling length into row groups, and each group into buckets of similar length.  Queries are cut into
blocks; a cell is one row group with one block of queries, all cells run in parallel, and each block first meets the longest
group for thresholds.  In a cell, a query's threshold, its own length and a bucket's greatest length give the least cosine
that a vector of the bucket must reach.  Above 1 the bucket is passed over.  Where it is high, a few coordinates of the query
bound those of the vector (coordinate pruning); elsewhere only vectors long enough are looked at (length pruning).  What is
left is verified by whole products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import stored

SCALE = 1024
#: Vectors of a bucket; bytes of vectors in a row group or of queries in a block, and the most rows of either.
BUCKET, CELL_BYTES, CELL_ROWS = 1024, 32 << 20, 32768
#: Rows that are worth a group of their own, where there are fewer groups than the session has cores for.
LEAST_ROWS = 2048
#: Local cosine from which coordinates are tested, and how many.
COORDINATE_COSINE, COORDINATES = 0.9, 4
#: Bounds in doubles are eased by this share.
EASE = 1e-9
LOW = np.iinfo(np.int64).min
#: Components beyond this stand for it: a whole number of 64 bits can't hold more.
MOST = float(1 << 62)

ROW_DDL = "at long, vec_id long, vector binary, length double"
FOUND = pa.schema([("at", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "at long, query_id long, vec_id long, score long"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows with a whole, finite vector: at (their number), vec_id, vector (little-endian 64-bit), length."""
    numbers = F.col("embedding").cast("array<double>")
    sound = numbers.isNotNull() & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, numbers).alias("v")).filter("v is not null")
    own = own.select(F.monotonically_increasing_id().alias("at"), "vec_id", "v")

    def run(batches):
        for batch in batches:
            vectors, lengths = [], []
            for v in batch["v"]:
                whole = np.clip(np.floor(SCALE * v.values.to_numpy(zero_copy_only=False)), -MOST, MOST).astype("<i8")
                vectors.append(whole.tobytes())
                lengths.append(float(np.sqrt((whole.astype(np.float64) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([batch["at"], batch["vec_id"], pa.array(vectors, pa.binary()), pa.array(lengths, pa.float64())], ["at", "vec_id", "vector", "length"])

    return own.mapInArrow(run, ROW_DDL)


def matrix(rows: pa.Table) -> np.ndarray:
    """The vectors of the rows, shorter ones filled up with zeros."""
    vectors = [np.frombuffer(v.as_buffer(), "<i8") for v in rows["vector"]]
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, exact; beyond 64 bits the nearest that fits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    size = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(width, 1)
    if size < 2.0 ** 52:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if size < 2.0 ** 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray):
        self.vectors, self.lengths = vectors, lengths
        self._unit = None

    def units(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.vectors / np.maximum(self.lengths, 1.0)[:, None]
        return self._unit

    def by_coordinates(self, query: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose leading coordinates allow a cosine of ``cosine`` with the unit vector ``query``.

        The rest of the coordinates add at most the product of what is left of both vectors."""
        rows = np.arange(len(self.lengths))
        width = min(len(query), self.vectors.shape[1])
        for f in np.argsort(-np.abs(query[:width]), kind="stable")[:COORDINATES].tolist():
            x = self.units()[rows, f]
            bound = query[f] * x + np.sqrt(np.maximum(1 - query[f] ** 2, 0) * np.maximum(1 - x ** 2, 0))
            rows = rows[bound >= cosine - 1e-7]
        return rows


class Found:
    """The best so far of every query of a block."""

    def __init__(self, ids: list, need: np.ndarray, top: int):
        self.null = np.array([i is None for i in ids])
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.need, self.top = need, top
        self.rows = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]  # query, score, null, vec_id

    def add(self, query: np.ndarray, score: np.ndarray, null: np.ndarray, vec: np.ndarray) -> None:
        """New candidates; each query keeps its best: high score, small vec_id, null vec_id last."""
        own = (self.ids[query] == vec) & (self.null[query] == null)
        good = ~own & (score >= self.need[query])
        if not good.any():
            return
        fresh = (query[good], score[good], null[good], vec[good])
        query, score, null, vec = (np.concatenate(c) for c in zip(self.rows, fresh))
        order = np.lexsort((vec, null, np.invert(score), query))
        query, score, null, vec = query[order], score[order], null[order], vec[order]
        first = np.searchsorted(query, query, "left")
        place = np.arange(len(query)) - first
        keep = place < self.top
        self.rows = [query[keep], score[keep], null[keep], vec[keep]]
        last = place == self.top - 1
        self.need[query[last]] = np.maximum(self.need[query[last]], score[last])


def search_cell(rows: pa.Table, queries: pa.Table, top: int, size: int = BUCKET) -> pa.Table:
    """(at, query_id, vec_id, score): of the cell's vectors, the best of each query that reach its threshold ``need``."""
    rows = rows.sort_by([("length", "descending")])
    vectors, lengths = matrix(rows), rows["length"].to_numpy()
    null = np.array([i is None for i in rows["vec_id"].to_pylist()], bool)
    ids = np.array([i or 0 for i in rows["vec_id"].to_pylist()], np.int64)
    asked, own_length = matrix(queries), queries["length"].to_numpy()
    found = Found(queries["vec_id"].to_pylist(), queries["need"].to_numpy().copy(), top)
    for start in range(0, len(lengths), size):
        bucket = Bucket(vectors[start:start + size], lengths[start:start + size])
        reach = own_length * bucket.lengths[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(found.need > 0, found.need / reach, -1.0)  # a threshold of 0 or less prunes nothing
        alive = ~(cosine > 1 + EASE)
        by_coordinate = alive & (cosine >= COORDINATE_COSINE)
        for q in np.flatnonzero(by_coordinate).tolist():
            some = bucket.by_coordinates(asked[q] / own_length[q], float(cosine[q]))
            if len(some):
                score = products(asked[q:q + 1], bucket.vectors[some])[0]
                found.add(np.full(len(some), q), score, null[start + some], ids[start + some])
        by_length = np.flatnonzero(alive & ~by_coordinate)
        if len(by_length):
            need = found.need[by_length]
            least = np.where(need > 0, need / np.maximum(own_length[by_length], 1.0) * (1 - EASE), 0.0)
            long_enough = np.searchsorted(-bucket.lengths, -least, "right")
            widest = int(long_enough.max())
            if widest:
                score = products(asked[by_length], bucket.vectors[:widest])
                score[np.arange(widest)[None, :] >= long_enough[:, None]] = LOW
                own = (found.ids[by_length][:, None] == ids[None, start:start + widest]) & (found.null[by_length][:, None] == null[None, start:start + widest])
                score[own] = LOW
                floor = np.maximum(need, LOW + 1)
                if widest > top:
                    floor = np.maximum(floor, np.partition(score, widest - top, axis=1)[:, widest - top])
                q, v = np.nonzero(score >= floor[:, None])
                found.add(by_length[q], score[q, v], null[start + v], ids[start + v])
    query, score, no_id, vec = found.rows
    return pa.Table.from_arrays([queries["at"].combine_chunks().take(pa.array(query)), queries["vec_id"].combine_chunks().take(pa.array(query)),
                                 pa.array(vec, mask=no_id), pa.array(score)], schema=FOUND)


def top_products(embeddings: DataFrame, every: int = 100, top: int = 10) -> DataFrame:
    """The ``top`` vectors of highest inner product with each query: query_id, rank, vec_id, score.

    A component x counts as floor(1024 * x); queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows but those of the query's own vec_id.  Equal scores by ascending vec_id, null vec_id (never a query) last.  Vectors that
    are null or hold a null or a number that isn't finite take no part.  Repeated rows are candidates each, and repeated queries
    answer each by itself.  A shorter vector, also an empty one, counts as filled up with zeros; whole numbers beyond 2^62
    and scores beyond 64 bits stand at that end.  An empty table gives no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = stored(whole_vectors(embeddings), "vectors")
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vector")).alias("bytes"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()[0]
    cell = max(1, min(CELL_ROWS, CELL_BYTES // max(seen["bytes"] or 1, 1)))
    groups = max(1, -(-seen["n"] // cell), min(spark.sparkContext.defaultParallelism, -(-seen["n"] // LEAST_ROWS)))
    blocks = max(1, -(-seen["q"] // cell))

    # Where each row group ends: lengths, then ids and row numbers, so that equal lengths are split too.
    dealt = vectors.repartitionByRange(groups, F.col("length").desc(), "vec_id", "at").select("*", F.spark_partition_id().alias("r"))
    dealt = stored(dealt, "vectors-by-length")
    queries = vectors.filter(F.col("vec_id") % every == 0).select("*", F.pmod(F.xxhash64("vec_id", "at"), F.lit(blocks)).cast("int").alias("c"))

    size = BUCKET

    def cells(rows: DataFrame, asked: DataFrame) -> DataFrame:
        left = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c")).groupBy("r", "c")
        return left.cogroup(asked.groupBy("r", "c")).applyInArrow(lambda a, b: search_cell(a, b, top, size), FOUND_DDL)

    order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    first = cells(dealt.filter("r = 0"), queries.select("*", F.lit(0).alias("r"), F.lit(LOW).cast("long").alias("need")))
    found = first = stored(first, "found-longest")
    if groups > 1:
        need = first.groupBy("at").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("tenth")).filter(F.col("k") >= top).select("at", "tenth")
        asked = (queries.join(need, "at", "left").select("*", F.coalesce("tenth", F.lit(LOW).cast("long")).alias("need")).drop("tenth")
                 .select("*", F.explode(F.sequence(F.lit(1), F.lit(groups - 1))).alias("r")))
        found = first.unionByName(cells(dealt.filter("r > 0"), asked))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
