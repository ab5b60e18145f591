"""Log sources derived from the supplied tables, for the registered queries and the benchmark.

No log files are supplied, so NDJSON objects are generated *by Spark* from the read-only tables
into the session's shared scratch folder (its checkpoint dir) and then loaded with the normal
load path.  Every generated line is a deterministic function of one input row, so an SQL engine
can compute the expected columns from the same table without parsing JSON.

`events` -> one messy line per event, ten shapes by event_id % 10 (see `event_line`);
files of 1000 consecutive event ids (`logs/app-00000.ndjson`, ...), line = position by event_id.
`orders` -> one line per order, files per order month and shard.
`lineitem` -> one line per item with `l_shipdate` as time (many rows share a timestamp).
`documents` -> one line per document with the whole text as msg.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import LogStore
from tidelog.session import configure, scratch_root
from tidelog.sources import fs
from tidelog.spec import Field, default_fields

EVENTS_PER_FILE = 1000
ORDERS_PER_FILE = 2000
ITEMS_PER_FILE = 200_000
DOCUMENTS_PER_FILE = 20_000
#: Beyond the 10 MiB that a line may have.
LONG_LINE = 11 * 1024 * 1024

_CACHE: dict = {}


def _s(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(str(c))


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def level_of(event_type: Column) -> Column:
    return (F.when(event_type == "error", "ERROR").when(event_type == "click", "INFO")
            .when(event_type == "view", "DEBUG").when(event_type == "purchase", "WARN").otherwise("info"))


def event_lines(events: DataFrame) -> DataFrame:
    """(event_id, g, line) -- the text of each generated line, before any '\\n'."""
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    c = F.col("event_id") % 10
    alt = (F.col("event_id") / 10).cast("bigint") % 2
    lvl = level_of(F.col("event_type"))
    msg = _cat(F.col("event_type"), " user_", _s(F.col("user_id")), " #", _s(F.col("event_id")))
    topic = _cat("svc-", _s(F.col("user_id") % 7))
    acc = _cat("A", _s(F.col("user_id")))
    f_t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    f_sp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    f_sec = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    f_day = F.date_format("ts", "yyyy-MM-dd")
    e_ms = F.timestamp_diff("MILLISECOND", epoch0, F.col("ts"))
    e_s = F.floor(e_ms / 1000).cast("bigint")
    sid = _s(F.col("event_id"))
    et = F.col("event_type")
    line = (
        F.when(c == 0, _cat('{"time":"', f_t, '-06:00","level":"', lvl, '","msg":"', msg, '","topic":"', topic,
                            '","accession":"', acc, '","study_uid":"S', sid, '","kind":"', et, '"}'))
        .when(c == 1, _cat('{":time":"', f_sec, '","level":"', lvl, '","msg":"', msg,
                           '",":topic":"gateway","topic":"', topic, '"}', F.when(alt == 1, "\r").otherwise("")))
        .when(c == 2, _cat('{"time":', _s(e_s), ',"level":"', lvl, '","msg":"', msg, '","accession":"', acc,
                           '","kind":"', et, '"}'))
        .when(c == 3, _cat('{"time":', _s(e_ms), ',"level":"', lvl, '","msg":"', msg, ' 100%","accession":',
                           _s(F.col("user_id")), ',"topic":"', topic, '"}'))
        .when(c == 4, F.when(alt == 0, _cat("plain text event ", sid))
              .otherwise(_cat('{"level":"INFO","msg":"x"} trailing ', sid)))
        .when(c == 5, F.when(alt == 0, F.lit("")).otherwise(F.lit("   ")))
        .when(c == 6, _cat('{"time":"', f_t, 'Z","level":null,"msg":"', msg, '","topic":"', topic, '"}'))
        .when(c == 7, _cat('{"time":', _s(e_s), '.5,"level":', _s(F.col("user_id") % 5), ',"msg":"', msg, '"}'))
        .when(c == 8, F.when(alt == 0, _cat('{"time":"', f_day, '",":time":"', f_sp, '","level":"', lvl,
                                            '","msg":"', msg, '"}'))
              .otherwise(_cat('{"time":null,":time":"', f_sp, '","level":"', lvl, '","msg":"', msg, '"}')))
        .otherwise(F.when(alt == 0, _cat('{"level":"', lvl, '","msg":"', msg, '","study_uid":"S', sid, '"}'))
                   .otherwise(_cat('{"time":"', _s(e_s), '","level":"', lvl, '","msg":"', msg, '"}')))
    )
    g = F.floor(F.col("event_id") / EVENTS_PER_FILE).cast("bigint")
    return events.select("event_id", g.alias("g"), line.alias("line"))


def event_file_name(g: Column) -> Column:
    return _cat("logs/app-", F.lpad(_s(g), 5, "0"), ".ndjson")


def order_lines(orders: DataFrame, shards: int) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    shard = F.col("o_orderkey") % shards
    name = _cat("orders/", month, "/part-", _s(shard), ".ndjson")
    return orders.select(name.alias("name"), F.col("o_orderkey").alias("k"), order_line().alias("line"))


def order_line() -> Column:
    return _cat('{"time":"', F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), '","level":"',
                F.col("o_orderstatus"), '","msg":"order ', _s(F.col("o_orderkey")), '","topic":"',
                F.col("o_orderpriority"), '","accession":"C', _s(F.col("o_custkey")), '"}')


def lineitem_lines(lineitem: DataFrame) -> DataFrame:
    shards = max(8, -(-lineitem.count() // ITEMS_PER_FILE))
    line = _cat('{"time":"', F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), '","level":"',
                F.col("l_returnflag"), '","msg":"order ', _s(F.col("l_orderkey")), ' line ',
                _s(F.col("l_linenumber")), '","topic":"', F.col("l_linestatus"), '"}')
    name = _cat("items/part-", F.lpad(_s(F.col("l_orderkey") % shards), 6, "0"), ".ndjson")
    return lineitem.select(name.alias("name"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("k"),
                           line.alias("line"))


def document_lines(documents: DataFrame) -> DataFrame:
    shards = max(4, -(-documents.count() // DOCUMENTS_PER_FILE))
    line = F.to_json(F.struct(F.col("lang").alias("level"), F.col("text").alias("msg"),
                              F.col("source").alias("topic"), _s(F.col("doc_id")).alias("doc")))
    name = _cat("docs/part-", F.lpad(_s(F.col("doc_id") % shards), 6, "0"), ".ndjson")
    return documents.select(name.alias("name"), F.col("doc_id").alias("k"), line.alias("line"))


def priority_lines(orders: DataFrame) -> DataFrame:
    """`order_lines` filed under a folder for each priority, whose number its text starts with."""
    shards = max(1, -(-orders.count() // (5 * ORDERS_PER_FILE)))
    name = _cat("p", F.substring("o_orderpriority", 1, 1), "/part-", _s(F.col("o_orderkey") % shards), ".ndjson")
    return orders.select(name.alias("name"), F.col("o_orderkey").alias("k"), order_line().alias("line"))


DOC_FIELDS = [Field("time", ("time",), True), Field("level", ("level",), True), Field("msg", ("msg",), True),
              Field("topic", ("topic",)), Field("doc", ("doc",))]


def write_ndjson(spark: SparkSession, lines: DataFrame, root: str) -> str:
    """Write (name, k, line) as NDJSON objects named `name` under root, lines in k order.

    Each object is written by one task (grouped by name, sorted by k), then renamed to its name."""
    tmp = f"{root}/_gen"
    (lines.repartition("name").sortWithinPartitions("name", "k").select("name", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("name").text(tmp))
    h = fs.Handle(spark, root)
    moves = [(p, f"{root}/" + unquote(p.split("/name=", 1)[1].split("/part-", 1)[0])) for p in fs.glob(spark, f"{tmp}/name=*/part-*")]
    for folder in {dst.rsplit("/", 1)[0] for _, dst in moves}:
        h.mkdirs(folder)
    h.rename_all(moves)
    h.delete(tmp, True)
    return root


def new_area(spark: SparkSession, name: str) -> str:
    configure(spark)
    return f"{scratch_root(spark)}/tidelog-derived/{name}-{uuid.uuid4().hex[:10]}"


def _events_lines_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    el = event_lines(ev)
    return el.select(event_file_name(F.col("g")).alias("name"), F.col("event_id").alias("k"), "line")


def build_source(spark: SparkSession, kind: str, sf_dir: str, fields=None, load: bool = True,
                 names_filter=None, split_bytes: int | None = None, cache: bool = True):
    """(store, spec, objects_root) for a derived source; cached per session and input folder."""
    key = (spark.sparkContext.applicationId, kind, sf_dir, load, names_filter is None, split_bytes)
    hit = _CACHE.get(key) if cache else None
    if hit is not None and fs.exists(spark, hit[0].spec_path(hit[1].id)):
        return hit
    area = new_area(spark, kind)
    objects = f"{area}/objects"
    if kind == "events":
        lines = _events_lines_named(spark, sf_dir)
    elif kind == "odd_names":
        lines = _events_lines_named(spark, sf_dir).withColumn("name", F.replace("name", F.lit("app-"), F.lit("a b+c%20[x]{y}-")))
    elif kind == "long_line":
        lines = _events_lines_named(spark, sf_dir).withColumn("line", F.when(
            F.col("k") == 0, _cat('{"msg":"', F.repeat(F.lit("x"), LONG_LINE), '"}')).otherwise(F.col("line")))
    elif kind == "orders":
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        n = orders.count()
        months = orders.select(F.date_format("o_orderdate", "yyyy-MM")).distinct().count()
        shards = max(1, -(-n // max(1, months * ORDERS_PER_FILE)))
        lines = order_lines(orders, shards)
    elif kind == "lineitem":
        lines = lineitem_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    elif kind == "burst":
        same = F.lit("1995-06-17 00:00:00").cast("timestamp_ntz")
        lines = lineitem_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_shipdate", same))
    elif kind == "marked":
        lines = _events_lines_named(spark, sf_dir).withColumn("line", F.when(
            (F.col("k") % EVENTS_PER_FILE == 0) & (F.floor(F.col("k") / EVENTS_PER_FILE) % 2 == 0), _cat("\ufeff", F.col("line"))).otherwise(F.col("line")))
    elif kind == "documents":
        lines = document_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        fields = fields or DOC_FIELDS
    else:
        raise ValueError(kind)
    # Sparse sources spanning years get monthly partitions; dense recent logs daily ones.
    unit = "month" if kind in ("lineitem", "orders", "burst") else "day"
    write_ndjson(spark, lines, objects)
    store = LogStore(spark, f"{area}/store")
    spec = store.create_source(kind, "path", {"root": objects}, fields=fields or default_fields(),
                               partition_unit=unit)
    if load:
        from tidelog.operators import load as L
        prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
        if split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        try:
            if names_filter is None:
                L.sync_source(store, spec)
            else:
                for _ in L.load_listed(store, spec, L.pending_files(store, spec).where(names_filter)):
                    pass
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    out = (store, spec, objects)
    if cache:
        _CACHE[key] = out
    return out
