"""Result pages over a source by its file-level time index (O-23, O-25, O-28).

Threshold top-k: data files are taken by falling greatest time, in disjoint blocks that grow; each block gives its own newest
rows (one `TakeOrderedAndProject`), which are merged with those kept so far.  Once the page is full and its last row is newer
than anything the next file holds, no further file can reach it.  No file is read twice for a page, so a needle that occurs
nowhere costs one scan and an unfiltered page costs a file or two.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.catalog import LogStore
from tidelog.functions import extract as X
from tidelog.operators import ngrams, placement
from tidelog.operators import search as Q
from tidelog.spec import SourceSpec

#: Rows up to which a page is merged in the driver; deeper offsets are left to `search.page`.
MOST_HELD = 20_000
#: Files of the second block; each later one has twice as many.
BLOCK_FILES = 16

RESULT = T.StructType([
    T.StructField("time", T.TimestampNTZType()), T.StructField("level", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("source_file", T.StringType()),
    T.StructField("source_line", T.IntegerType()),
])


@dataclass
class Page:
    rows: list[Row]
    has_more: bool
    #: Data files of each block that was read, in the order of reading.
    blocks: list[list[str]] = field(default_factory=list)


def _place(row: Row) -> tuple:
    t = row["time"]
    return (t is None, _falling(t), row["source_file"].encode(), row["source_line"])


def _falling(t: datetime | None) -> int:
    if t is None:
        return 0
    d = t - datetime(1970, 1, 1)
    return -((d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds)


def newest_rows(store: LogStore, spec: SourceSpec, need: int, where: list[Column], files) -> tuple[list[Row], list[list[str]]]:
    """The `need` newest rows that pass `where`, in page order, and the blocks of files read for them."""
    kept: list[Row] = []
    blocks: list[list[str]] = []
    ahead = next(files, None)
    size = 0
    while ahead is not None:
        if len(kept) >= need and kept[need - 1]["time"] is not None and (ahead.max_time is None or kept[need - 1]["time"] > ahead.max_time):
            break
        block, rows = [], 0
        while ahead is not None and (len(block) < size or (not size and rows < need)):
            block.append(ahead.path)
            rows += ahead.n_rows
            ahead = next(files, None)
        size = max(BLOCK_FILES, 2 * len(block))
        blocks.append(block)
        df = store.spark.read.schema(spec.storage_schema()).option("basePath", store.data_dir(spec.id)).parquet(*block)
        test = X.all_of(where)
        df = df if test is None else df.where(test)
        found = df.orderBy(*Q.order()).limit(need).select(*Q.result_columns(spec)).collect()
        kept = sorted(kept + found, key=_place)[:need]
    return kept, blocks


def page(store: LogStore, spec_or_id, offset: int = 0, size: int = Q.PAGE_SIZE, cursor: tuple | None = None, time_from: datetime | None = None,
         time_to: datetime | None = None, level: str = "", fields: dict | None = None, text: str = "") -> Page:
    """Combined search, newest first: `size` rows from `offset`, or those after `cursor` (time, file, line of the last row seen)."""
    spec = spec_or_id if isinstance(spec_or_id, SourceSpec) else store.get(spec_or_id)
    store.get(spec.id)
    where = Q.predicates(spec, time_from, time_to, level, fields, text)
    offset = max(0, int(offset))
    need = offset + size + 1
    if need > MOST_HELD:
        rows = Q.page(store.table(spec).where(X.all_of(where) if where else F.lit(True)), spec, offset, size).collect()
        return Page(rows[:size], len(rows) > size)
    if cursor is not None:
        where = where + [after(cursor)]
    last = None if cursor is None else cursor[0]
    files = placement.newest_files(store, spec, time_from, time_to, last, cursor is not None and last is None,
                                   ngrams.files_without(store, spec, ngrams.needles(spec, fields, text)))
    rows, blocks = newest_rows(store, spec, need, where, files)
    return Page(rows[offset:offset + size], len(rows) > offset + size, blocks)


def after(cursor: tuple) -> Column:
    """Rows behind a cursor in page order."""
    t, name, line = cursor
    tie = (F.col("source_file") > F.lit(name)) | ((F.col("source_file") == F.lit(name)) & (F.col("source_line") > F.lit(line)))
    if t is None:
        return F.col("time").isNull() & tie
    at = F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.col("time").isNull() | (F.col("time") < at) | ((F.col("time") == at) & tie)


def as_frame(store: LogStore, rows: list[Row]) -> DataFrame:
    """Page rows as a DataFrame."""
    return store.spark.createDataFrame([tuple(r) for r in rows], RESULT)
