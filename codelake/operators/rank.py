"""Rankings, the first rows of groups, and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import contains_any


def importance(path: Column, n_classes: Column, n_functions: Column, words=tables.RANK_WORDS, per_class: int = tables.RANK_PER_CLASS, per_function: int = tables.RANK_PER_FUNCTION) -> Column:
    """Points of a file for its path, its classes and its functions."""
    out = F.coalesce(n_classes, F.lit(0)) * per_class + F.coalesce(n_functions, F.lit(0)) * per_function
    for points, some in words:
        out = out + F.when(contains_any(F.lower(path), some), points).otherwise(0)
    return out.cast("long")


def top_files(files: DataFrame, n: int = 10, order: str = "file_ord", **options) -> DataFrame:
    """The ``n`` most important files, equal points in file order; one TakeOrderedAndProject."""
    return files.withColumn("score", importance(F.col("path"), F.col("n_classes"), F.col("n_functions"), **options)).orderBy(F.desc("score"), order).limit(n)


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark cuts groups to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_of(array: Column, n: int) -> Column:
    """The first ``n`` elements."""
    return F.slice(array, 1, n)


def top_and_other(groups: DataFrame, name: str, size: str, most: int = 8, other: str = "…other") -> DataFrame:
    """At most ``most`` rows by size, then name; if there are more groups, the last one stands for
    the rest and has their sum. rank from 1."""
    head = groups.select(F.col(name), F.col(size)).orderBy(F.desc(size), name).limit(most)
    head = head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(size), name)))
    totals = groups.agg(F.count(F.lit(1)).alias("_k"), F.sum(size).alias("_all"))
    shown = F.sum(F.when(F.col("rank") < most, F.col(size))).over(Window.partitionBy())
    rows = head.join(F.broadcast(totals)).withColumn("_shown", shown)
    last = (F.col("_k") > most) & (F.col("rank") == most)
    return rows.select(F.when(last, F.lit(other)).otherwise(F.col(name)).alias(name), F.when(last, F.col("_all") - F.coalesce("_shown", F.lit(0))).otherwise(F.col(size)).alias(size), "rank")


def largest(rows: DataFrame, size: str, name: str, n: int = 12) -> DataFrame:
    """The ``n`` largest, equal ones by name."""
    return rows.orderBy(F.desc(size), name).limit(n)


def capped_edges(edges: DataFrame, per_source: int = 3, most: int = 15) -> DataFrame:
    """Edges of a diagram: at most ``per_source`` targets each, ``most`` in all, by source and target."""
    return first_per_group(edges.select("src", "dst").distinct(), ["src"], [F.col("dst")], per_source).orderBy("src", "dst").limit(most).select("src", "dst")


def folder_nodes(dirs: DataFrame, per_depth: int = 8, depths: int = 2) -> DataFrame:
    """Directories of a diagram: the shallowest ``depths`` levels, ``per_depth`` of each, in the order met.

    ``dirs``: dir, depth, parent, first_ord. Adds node number and parent_node (null: the root)."""
    levels = dirs.select("depth").distinct().orderBy("depth").limit(depths)
    shown = first_per_group(dirs.join(F.broadcast(levels), "depth", "left_semi"), ["depth"], [F.col("first_ord"), F.col("dir")], per_depth)
    nodes = shown.withColumn("node", F.row_number().over(Window.orderBy("depth", "rank")))
    parents = nodes.select(F.col("dir").alias("parent"), F.col("node").alias("parent_node"))
    return nodes.join(parents, "parent", "left").select("node", "dir", "depth", "parent", "parent_node")


def schedule(arrivals: DataFrame, at: str, gap: float, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """start: the times of calls that arrive at ``at`` and must be ``gap`` apart.

    start_i = max(arrive_i, start_{i-1} + gap) in closed form: i * gap plus the running maximum of
    arrive_j - j * gap. Sequences by ``by``; without it, all rows are one sequence: they are dealt
    to sorted ranges, whose sizes and maxima, a row for each range, are carried on from one to the next."""
    order = order or [at]
    wide = F.lit(gap).cast("long") if isinstance(gap, int) else F.lit(gap)
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        rows = arrivals.withColumn("_i", F.row_number().over(w) - 1)
        ahead = F.max(F.col(at) - F.col("_i") * wide).over(running(w))
        return rows.withColumn("start", F.col("_i") * wide + ahead).drop("_i")
    from .graph import _cut

    dealt = _cut(arrivals.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order)
    rows = dealt.withColumn("_i", (F.row_number().over(w) - 1).cast("long"))
    ranges = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(at) - F.col("_i") * wide).alias("_m"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    ranges = ranges.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = ranges.withColumn("_past", F.max(F.col("_m") - F.col("_first") * wide).over(before)).select("_p", "_first", "_past")
    rows = rows.join(F.broadcast(ranges), "_p").withColumn("_k", F.col("_first") + F.col("_i"))
    ahead = F.greatest(F.max(F.col(at) - F.col("_k") * wide).over(running(w)), F.col("_past"))
    return rows.withColumn("start", F.col("_k") * wide + ahead).select(*arrivals.columns, "start")


def until_reached(rows: DataFrame, group_order: str, order: str, enough: int) -> DataFrame:
    """Rows of groups, in order, up to and with the group that brings their number to ``enough``."""
    sizes = rows.groupBy(group_order).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.orderBy(group_order).limit(enough)  # a group has a row at least, so no more are needed
    w = Window.orderBy(group_order).rowsBetween(Window.unboundedPreceding, -1)
    taken = first.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(F.col("_before") < enough)
    return rows.join(F.broadcast(taken.select(group_order)), group_order, "left_semi").orderBy(group_order, order)
