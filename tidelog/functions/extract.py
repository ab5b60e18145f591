"""Column expressions that turn one NDJSON line into typed columns (O-10 ... O-18, O-24).

Everything here is a native Catalyst expression, evaluated inside whole-stage codegen on the
executors; no Python runs per row.  The line is parsed once into a VARIANT and every field reads
from that value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.session import kept_columns

# Fixed values that must match for identical behaviour.
# Characters a whitespace trim removes (Unicode White_Space); a line made only of them is blank.
BLANK_LINE_PATTERN = (r"\A[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\z")
# Accepted time layouts: RFC 3339 ('T', mandatory 'Z' or +hh:mm offset) or 'YYYY-MM-DD HH:MM:SS'
# without offset; 1-2 digit hour; optional '.' or ',' fraction of any length.
# An offset has 24 hours and 60 minutes at most.
TIME_PATTERN = (r"\A(\d{4}-\d{2}-\d{2})"
                r"(?:T(?<t>\d{1,2}:\d{2}:\d{2})(?:[.,](?<tf>\d{1,6})\d*)?(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))"
                r"| (?<s>\d{1,2}:\d{2}:\d{2})(?:[.,](?<sf>\d{1,6})\d*)?)\z")
# Epoch numbers above this are milliseconds, otherwise seconds.
EPOCH_MILLIS_ABOVE = 1e12
# Lines at least this long make the whole file fail.
MAX_LINE_BYTES = 10 * 1024 * 1024
# event_date partition values are kept inside this range; other dates go to the NULL partition.
EVENT_DATE_MIN = "1970-01-01"
EVENT_DATE_MAX = "2100-12-31"
# Severity buckets of a level, compared case-insensitively.
SEVERITY = (
    ("error", ("ERROR", "FATAL", "CRITICAL")),
    ("warn", ("WARN", "WARNING")),
    ("info", ("INFO",)),
    ("debug", ("DEBUG", "TRACE")),
)

#: How Spark prints numbers that aren't finite.
QUOTED_NUMBERS = ('"Infinity"', '"-Infinity"', '"NaN"')


def _epoch0() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def strip_cr(value: Column) -> Column:
    """Lines are split on '\\n' only; one trailing '\\r' is dropped (O-4)."""
    return F.when(value.endswith("\r"), F.left(value, F.char_length(value) - F.lit(1))).otherwise(value)


def is_blank(raw: Column) -> Column:
    """Whitespace-only line (O-10): neither a row nor a skip, but it keeps its line number."""
    return ~raw.startswith("{") & raw.rlike(BLANK_LINE_PATTERN)


def parse_line(raw: Column) -> Column:
    """Parse `[raw, <hash of raw>]` as one JSON array (O-11).

    A plain parse of `raw` accepts trailing text after the first value.  Appending a newline and
    a number only the line itself determines makes any early end of `raw` visible: the array is
    a strict JSON document whose second element is that number only when `raw` is exactly one
    complete JSON value.  The newline closes nothing and is invalid inside a string.
    """
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit("\n,"), F.xxhash64(raw).cast("string"), F.lit("]")))


def is_valid(v: Column, raw: Column) -> Column:
    """Valid row: a JSON object or the bare literal null, and nothing after it (T9-T11)."""
    tail_ok = F.try_variant_get(v, "$[1]", "bigint") == F.xxhash64(raw)
    head_ok = raw.startswith("{") | raw.rlike(r"\A[ \t\r]*[{n]")
    return F.coalesce(tail_ok & head_ok, F.lit(False))


def wanted_keys(fields) -> list[str]:
    """Every JSON key any field reads, once, in first-use order."""
    return list(dict.fromkeys(k for f in fields for k in f.json_keys))


def key_struct(v: Column, keys: list[str]) -> Column:
    """All wanted top-level values of the line object in one cast (NULL where absent).

    One object -> struct conversion replaces a path lookup per key; field matching is exact
    (case-sensitive) and a repeated key keeps its last value."""
    ddl = ",".join("`" + k.replace("`", "``") + "`:variant" for k in keys)
    return F.try_variant_get(v, "$[0]", f"struct<{ddl}>")


def parse_time_string(s: Column) -> Column:
    """Wall-clock timestamp of an accepted layout; any offset is discarded (O-15, T6, T8)."""
    # Of the two layouts one has matched: the other's groups are empty.
    plain = F.when(s.rlike(TIME_PATTERN), F.regexp_replace(s, TIME_PATTERN, "$1 ${t}${s}.${tf}${sf}0"))
    return plain.try_cast("timestamp_ntz")


#: Milliseconds beyond which microseconds no longer fit in 64 bits: NULL, not an overflow.
EPOCH_MILLIS_END = 9.223372036854775e15


def epoch_to_ts(f: Column) -> Column:
    """Epoch number in UTC (O-16, T7): above 1e12 milliseconds (integer part), else seconds
    with the fraction kept to the microsecond (floored).  Non-finite or out-of-range -> NULL."""
    ms = F.when((f > EPOCH_MILLIS_ABOVE) & (f < EPOCH_MILLIS_END),
                F.timestamp_add("MILLISECOND", f.cast("bigint"), _epoch0()))
    sec = f.cast("bigint")
    ns = ((f - sec) * 1e9).cast("bigint")
    us = sec * 1000000 + F.floor(ns / 1000.0).cast("bigint")
    secs = F.when((f <= EPOCH_MILLIS_ABOVE) & (f > -9.2e12), F.timestamp_add("MICROSECOND", us, _epoch0()))
    return F.coalesce(ms, secs)


def event_date(time: Column, ingested_at: Column, unit: str = "day") -> Column:
    """Partition key: start of the day (or month) of the retention key, NULL outside the range."""
    d = F.to_date(F.coalesce(time, ingested_at))
    key = d if unit == "day" else F.trunc(d, "month")
    return F.when(d.between(F.lit(EVENT_DATE_MIN).cast("date"), F.lit(EVENT_DATE_MAX).cast("date")), key)


def unit_start(d, unit: str = "day"):
    """Partition value holding date `d`."""
    return d if unit == "day" else d.replace(day=1)


def unit_next(d, unit: str = "day"):
    """Start of the partition after the one starting at `d`."""
    from datetime import timedelta
    if unit == "day":
        return d + timedelta(days=1)
    return (d.replace(day=28) + timedelta(days=4)).replace(day=1)


def severity_bucket(level: Column) -> Column:
    """Level -> error / warn / info / debug / other, case-insensitive; NULL -> other (O-18)."""
    u = F.upper(F.coalesce(level, F.lit("")))
    expr = None
    for name, members in SEVERITY:
        expr = (F.when(u.isin(*members), F.lit(name)) if expr is None
                else expr.when(u.isin(*members), F.lit(name)))
    return expr.otherwise(F.lit("other"))


def fields_map(columns: list[str]) -> Column:
    """Map of column -> value without NULL entries (O-24)."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))
    return F.map_filter(m, lambda k, val: val.isNotNull())


def extract_df(df, struct_col: str, fields, keep: list[str]):
    """Field extraction as three small projections over materialized intermediates.

    One projection holding every branch would repeat each lookup and each time-string input in
    every CASE branch (subexpression elimination skips conditional branches) and grow past the
    code generation size limit.  Here each value is read once per key, the per-key time
    candidates are parsed from plain columns, and the final step only coalesces."""
    for columns in _extraction(struct_col, tuple(fields), tuple(keep)):
        df = df.select(*columns)
    return df


@kept_columns
def _extraction(struct_col: str, fields: tuple, keep: tuple[str, ...]) -> list[list]:
    """Columns of each of these projections, in turn."""
    s = F.col(struct_col)
    keys = wanted_keys(fields)
    time_keys = [k for f in fields if f.column == "time" for k in f.json_keys]
    text_keys = list(dict.fromkeys(k for f in fields if f.column != "time" for k in f.json_keys))
    # Step 0: each wanted value as JSON text (NULL when the key is absent).  Its first character
    # is the JSON type: '"' string, digit or '-' number, 'n' null, anything else no match.
    step0 = [*[F.to_json(s.getField(k)).alias(f"_j{i}") for i, k in enumerate(keys)],
             *[s.getField(k).alias(f"_v{i}") for i, k in enumerate(keys)]]
    step1 = []
    for i, k in enumerate(keys):
        j, x = F.col(f"_j{i}"), F.col(f"_v{i}")
        head = F.substring(j, 1, 1)
        # A string without escapes is its JSON text minus the quotes; otherwise decode it.
        as_str = F.when(F.instr(j, "\\") == 0, F.expr(f"substring(_j{i}, 2, length(_j{i}) - 2)")) \
            .otherwise(F.variant_get(x, "$", "string"))
        if k in text_keys:
            # A number too large for a double prints as a quoted word, yet isn't a string.
            text = (head == '"') & ~(j.isin(*QUOTED_NUMBERS) & (F.schema_of_variant(x) != "STRING"))
            step1.append(F.when(text, as_str).when(j == "null", F.lit("")).alias(f"_x{i}"))
        if k in time_keys:
            step1.append(F.when(head == '"', as_str).alias(f"_s{i}"))
            step1.append(F.when(head.rlike("[-0-9]"), j.try_cast("double")).alias(f"_d{i}"))
    step2 = [F.coalesce(parse_time_string(F.col(f"_s{keys.index(k)}")),
                        epoch_to_ts(F.col(f"_d{keys.index(k)}"))).alias(f"_t{keys.index(k)}")
             for k in dict.fromkeys(time_keys)]
    step2 += [F.col(f"_x{keys.index(k)}") for k in text_keys]
    final = []
    for f in fields:
        prefix = "_t" if f.column == "time" else "_x"
        cols = [F.col(f"{prefix}{keys.index(k)}") for k in f.json_keys]
        final.append((F.coalesce(*cols) if len(cols) > 1 else cols[0]).alias(f.column))
    kept = [F.col(c) for c in keep]
    return [[*kept, *step] for step in (step0, step1, step2, final)]


def all_of(preds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, preds) if preds else None
