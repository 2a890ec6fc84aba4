"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a join and a distinct on the edges, written to the shared folder;
nothing is collected but a count and a checksum of the edges.  A hub keeps its
many neighbours as separate rows, which the adaptive skew join deals out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.storage import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        .where("a <> b").distinct()
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node reachable from every node that has a link.

    ``links`` holds pairs of long ids in any order, repeats and self-links allowed; nodes without a link to another are left out."""
    edges = durable(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        edges = durable(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # every edge is now (node, least node); the least node itself is added
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
