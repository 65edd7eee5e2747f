"""Connected components of an undirected graph, by label exchange between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import mark, materialize, release


def _small(df: DataFrame, tag: str, rows: int) -> DataFrame:
    """A shared table in as many files as its rows ask for."""
    return materialize(df.coalesce(max(8, rows // 500_000)), tag, "uncompressed")


def _mark(stars: DataFrame) -> tuple:
    """Number of rows and checksums of the rows, which don't depend on their order."""
    h = F.xxhash64("a", "b")
    return tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(edges: DataFrame, known: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges(a, b)``, and of
    ``known``, an earlier result whose components are to be extended.

    Alternating large-star and small-star steps: each hooks a node's neighbours to the smallest
    one, so the number of rounds grows with the logarithm of the longest path. Rounds are
    written to shared tables. Nodes with a 64th of all links or more, 128 of them at most, are
    sent to the links instead, so that no task gets all links of a hub."""
    spark = edges.sparkSession
    if known is not None:
        edges = edges.select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = materialize(edges.select(high.alias("a"), low.alias("b")).filter("a <> b").distinct(), "star-links", "uncompressed")
    seen = _mark(stars)
    for _ in range(max_rounds):
        at = mark()
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "a"))
        hubs = F.broadcast(least.filter(F.col("n") >= max(64, seen[0] // 64)).select("a", F.col("m").alias("hub_m")))
        upward = both.filter("b > a").join(hubs, "a", "left")
        large = upward.filter("hub_m is not null").select("b", F.col("hub_m").alias("m"))
        large = large.unionByName(upward.filter("hub_m is null").join(least, "a").select("b", "m"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = _small(large, "large-star", seen[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        small = _small(small, "small-star", seen[0])
        release(spark, at, at + 1)
        now = _mark(small)
        stars = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links did not settle within {max_rounds} rounds")
    tops = stars.select("b").distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select(F.col("b").alias("node"), F.col("b").alias("component")))
