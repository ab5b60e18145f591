"""Continuous auto-load (O-52) with Structured Streaming.

The stream is over the *listing*, not the lines: a `binaryFile` stream with the content column
pruned delivers each new object once; `foreachBatch` runs the batch loader on those names
(anti-joined with the manifest).  A batch that is done leaves a record under its number beside the
stream's checkpoint, so one that is replayed because the stream died before its commit is known and
skipped; one that died halfway is loaded on, file by file as the markers tell.  How many files or bytes
one batch takes can be limited.  Files that fail are recorded and
tried again with the next batch; the stream goes on.  Line numbering needs a batch
read, which is why lines are not streamed directly.  No watermark: a late file is still loaded.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.catalog import LogStore, compact_manifest
from tidelog.operators import load as L
from tidelog.operators import placement
from tidelog.sources import fs, listing

LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def failed_files(store: LogStore, sid: str) -> dict[str, str]:
    """Names that the stream could not load, with their errors; they are tried again with every batch."""
    p = _failures(store, sid)
    return json.loads(fs.read_text(store.spark, p)) if fs.exists(store.spark, p) else {}


def _failures(store: LogStore, sid: str) -> str:
    return f"{store.table_dir(sid)}/autoload-failures.json"


def done_batches(store: LogStore, checkpoint: str) -> list[int]:
    """Numbers of the batches that a stream with this checkpoint has loaded."""
    return sorted(int(n[:-len(".json")]) for n in fs.Handle(store.spark, checkpoint).names(checkpoint + "/loaded") if n.endswith(".json"))


def _batch_loader(store: LogStore, sid: str, checkpoint: str):
    def run(batch: DataFrame, epoch_id: int) -> None:
        spec = store.get(sid)
        record = f"{checkpoint}/loaded/{epoch_id}.json"
        if fs.exists(store.spark, record):
            return
        root_q = fs.qualify(store.spark, spec.root_uri).rstrip("/")
        start = len(root_q) + 2
        cand = batch.select(F.substring("path", start, 1 << 30).alias("name"), "path",
                            F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        if spec.prefix:
            cand = cand.where(F.col("name").startswith(spec.prefix))
        cand = listing.filter_by_age(cand, spec.load_days_back)
        cand = listing.new_files(cand, store.manifest_raw(spec.id))
        # A bad file is kept for the next batch and never holds up the others; its number is what one batch takes at most.
        failed, loaded = {}, 0
        before = failed_files(store, sid)
        for s in L.load_listed(store, spec, cand):
            before.pop(s.file_name, None)
            if s.error:
                failed[s.file_name] = s.error
            else:
                loaded += 1
        for s in L.load_files(store, spec, list(before)) if before else []:
            if s.error:
                failed[s.file_name] = s.error
        if failed or before:
            fs.write_text(store.spark, _failures(store, sid), json.dumps(failed))
        # Every batch adds a few small files to these; unmerged, each batch would read those of all before it.
        compact_manifest(store, sid)
        placement.compact_index(store, spec)
        fs.write_text(store.spark, record, json.dumps({"batch": epoch_id, "loaded": loaded, "failed": len(failed)}))
    return run


def start_autoload(store: LogStore, sid: str, checkpoint: str | None = None,
                   processing_time: str | None = None, available_now: bool = False,
                   max_files: int | None = None, max_bytes: str | None = None) -> StreamingQuery:
    """Start the listing stream for one source.  `available_now` loads what exists and stops;
    otherwise it polls every `processing_time` (default: the source's poll interval).  A batch takes `max_files`
    files or `max_bytes` at most (one of the two; by default all that is new)."""
    spark = store.spark
    spec = store.get(sid)
    root_q = fs.qualify(spark, spec.root_uri)
    reader = spark.readStream.format("binaryFile").schema(LISTING_SCHEMA).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    stream = reader.load(root_q).select("path", "modificationTime", "length")
    ckpt = fs.qualify(spark, checkpoint or f"{store.table_dir(sid)}/stream-checkpoint")
    w = stream.writeStream.foreachBatch(_batch_loader(store, sid, ckpt)).option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=processing_time or f"{spec.poll_minutes} minutes")
    return w.start()
