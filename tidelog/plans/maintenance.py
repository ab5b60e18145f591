"""Scheduled maintenance (O-50, O-51): which sources are due, and one pass over them."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import LogStore, compact_manifest
from tidelog.operators import load as L
from tidelog.operators import placement
from tidelog.operators import retention as R


def due_predicate(now: datetime) -> Column:
    """Due = auto-load or retention configured, and never polled or the interval has passed (T28)."""
    now_lit = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    has_work = F.col("auto_load") | (F.col("retention_days") > 0) | (F.col("max_size_mb") > 0)
    elapsed = F.timestamp_diff("SECOND", F.col("last_polled_at"), now_lit)
    return has_work & (F.col("last_polled_at").isNull() | (elapsed >= F.col("poll_minutes") * 60))


def due_sources(sources: DataFrame, now: datetime) -> DataFrame:
    return sources.where(due_predicate(now))


@dataclass
class MaintenanceReport:
    source_id: str
    files_loaded: int = 0
    retention: R.RetentionResult | None = None
    reencoded_partitions: int = 0
    reencoded_bytes: int = 0
    errors: list[str] = field(default_factory=list)


def run_maintenance(store: LogStore, now: datetime) -> list[MaintenanceReport]:
    """Per due source: load new files, apply retention, mark polled.  Then every source's files of another codec are
    re-encoded and its manifest merged.  Each step's failure is isolated and reported, a failed file's too; a source
    counts as polled even when a step failed.  Sources that only got housekeeping are reported where it did something."""
    reports = {}
    for sid in [r["id"] for r in due_sources(store.sources_df(), now).select("id").collect()]:
        rep = reports[sid] = MaintenanceReport(sid)
        spec = store.get(sid)
        if spec.auto_load:
            with _reported(rep, "load"):
                for s in L.sync(store, spec, now):
                    if s.error:
                        rep.errors.append(f"load: {s.file_name}: {s.error}")
                    else:
                        rep.files_loaded += 1
        if spec.retention_days > 0 or spec.max_size_mb > 0:
            with _reported(rep, "retention"):
                rep.retention = R.apply_retention(store, spec, now)
        store.mark_polled(sid, now)
    for spec in store.list_sources():
        rep = reports.get(spec.id) or MaintenanceReport(spec.id)
        with _reported(rep, "housekeeping"):
            rep.reencoded_partitions = len(R.legacy_partitions(store, spec.id))
            rep.reencoded_bytes = R.reencode(store, spec)
            compact_manifest(store, spec.id)
            placement.compact_index(store, spec)
        if rep.reencoded_partitions or rep.errors:
            reports[spec.id] = rep
    return list(reports.values())


@contextmanager
def _reported(rep: MaintenanceReport, step: str):
    try:
        yield
    except Exception as e:  # noqa: BLE001 - one source's failure must not stop the pass
        rep.errors.append(f"{step}: {e}")
