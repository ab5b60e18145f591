"""tidelog: structured NDJSON log loading and search, expressed as Spark jobs.

A *source* declares where NDJSON files live, which JSON keys become columns and how long rows
are kept.  Loading numbers and parses lines with native column expressions and appends them to
a ZSTD Parquet table partitioned by event date; search, retention and compaction are DataFrame
plans over that table.
"""

from tidelog.spec import Field, SourceSpec, default_fields, sanitize_ident
from tidelog.session import configure

__all__ = ["Field", "SourceSpec", "default_fields", "sanitize_ident", "configure"]
