"""Call chains by number: counted without listing them, and drawn by their rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .elimination import WAYS, solve
from .scratch import Scratch


def chain_counts(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """node, n: the exact number of ways from a node down to a node that calls nothing (1 for such a
    node itself), as decimal(38,0). Nodes on or above a cycle have no finite number and are left out."""
    return solve(edges, {"n": WAYS}, vertices)


def chains_at(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """start, rank, chain for each of ``wanted(start, rank)``: the chain of that rank, from 0, among all chains
    from a start in the order of their nodes. Ranks outside the number of chains give no row.

    A step chooses the link whose stretch of ranks holds the one left, so no other chain is made. The links lie
    in buckets of their start, so a step moves only one short row a chain; the rows of all steps become chains at the end."""
    s = Scratch(edges.sparkSession)
    counts = chain_counts(edges)
    links = edges.select("src", "dst").distinct().join(counts.withColumnRenamed("node", "dst"), "dst")
    before = F.sum("n").over(Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1))
    links = links.join(counts.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("at"), "dst", "n", F.coalesce(before, F.lit(0).cast("decimal(38,0)")).alias("before"))
    with s.bucketed(links, "at") as links:
        rows = wanted.select("start", "rank").distinct().join(counts.withColumnRenamed("node", "start"), "start").filter("rank >= 0 and rank < n")
        rows = s.cut(rows.select("start", "rank", F.col("start").alias("at"), F.col("rank").cast("decimal(38,0)").alias("left")))
        steps = [rows]
        while steps[-1].take(1):
            step = steps[-1].join(links, "at").filter("left >= before and left < before + n")
            steps.append(s.cut(step.select("start", "rank", F.col("dst").alias("at"), (F.col("left") - F.col("before")).cast("decimal(38,0)").alias("left"))))
        every = None
        for i, rows in enumerate(steps):
            place = rows.select("start", "rank", F.struct(F.lit(i).alias("place"), "at").alias("step"))
            every = place if every is None else every.unionByName(place)
        chain = F.transform(F.array_sort(F.collect_list("step")), lambda x: x["at"])
        return s.result(every.groupBy("start", "rank").agg(chain.alias("chain")))


def chain_page(edges: DataFrame, start, first: int, size: int) -> DataFrame:
    """``size`` chains of one start from rank ``first`` on."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    return chains_at(edges, spark.range(first, first + size).select(F.lit(start).cast(kind).alias("start"), F.col("id").alias("rank")))
