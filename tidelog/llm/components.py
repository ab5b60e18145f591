"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import stored

#: Links written by one task, about: tables of links are small rows, and few files keep the steps short.
LINKS_A_TASK = 50_000


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).coalesce(n), "star-least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    edges = stored(edges.filter("a <> b").distinct().coalesce(n), "star-links")
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(n), "star-least")
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b), a stored table -> a, root: the least id that each linked id reaches; ids that are a root are not listed.

    A node of any number of links is one row for each task before its links are shuffled for the minimum; the joins
    are between stored tables, so Spark splits such a node's rows.  The number of steps grows with the logarithm of
    the longest chain.  No links: no rows.
    """
    n = max(1, -(-links.count() // LINKS_A_TASK))
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(n), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select("a", F.col("b").alias("root"))
        mark = now
        edges = stored(_small_star(_large_star(edges, n), n).distinct().coalesce(n), "links")
