"""Graph operators over ``edges(src, dst)``; src depends on dst.

Loops write each round's table to the shared folder of ``spark.checkpoint.dir``, so plans stay
short and a lost executor costs no round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as _components
from .elimination import LEVEL, solve
from .numbering import numbered
from .scratch import shared_folder

cycles = _components.cycles


def _cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dependencies(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("src") == F.lit(node)).select("dst").distinct()


def dependents(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("dst") == F.lit(node)).select("src").distinct()


def closure(edges: DataFrame, starts: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """src, dst for everything reachable; a start is not its own dependency, even on a cycle.

    Semi-naive: only pairs that a round has found go on. ``starts(id)`` limits the sources."""
    links = edges.select("src", "dst").distinct()
    reach = links if starts is None else links.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    reach = front = _cut(reach)
    for _ in range(max_rounds):
        step = front.select("src", F.col("dst").alias("via")).join(links.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        front = _cut(step.join(reach, ["src", "dst"], "left_anti"))
        if not front.take(1):
            return reach.filter("src <> dst")
        reach = reach.unionByName(front)
    raise RuntimeError(f"the closure did not end within {max_rounds} rounds")


def cycle_members(edges: DataFrame) -> DataFrame:
    """id of every node that reaches itself: members of components of several nodes, and nodes with a link to themselves."""
    labels = _components.components(edges)
    several = labels.groupBy("component").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("id"))
    return labels.join(several, "component", "left_semi").select("id").unionByName(loops).distinct()


def topological_levels(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """node, level: 0 for nodes that depend on nothing, else one more than the highest of what they
    depend on. Nodes on or above a cycle have no level and are left out."""
    return solve(edges, {"level": LEVEL}, vertices)


def entry_nodes(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices that depend on nothing."""
    return vertices.select("id").distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def leaf_nodes(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices that nothing depends on."""
    return vertices.select("id").distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def call_chains(edges: DataFrame, start=None, max_depth: int = 10) -> DataFrame:
    """chain: every path from ``start`` (or each node that is called by none) to a node that calls
    nothing. Branches that return to a node on the path, or are longer than ``max_depth``, go; see
    ``chains`` for exact numbers and for chains of any length by their rank."""
    links = _cut(edges.select("src", "dst").distinct())
    ends = links.select("src").distinct()
    if start is None:
        roots = links.join(links.filter("src <> dst").select(F.col("dst").alias("src")), "src", "left_anti").select("src").distinct()
    else:
        roots = edges.sparkSession.createDataFrame([(start,)], links.select("src").schema)
    paths, found = roots.select(F.array("src").alias("chain")), None
    for _ in range(max_depth):
        paths = _cut(paths.withColumn("src", F.element_at("chain", -1)))
        over = paths.join(ends, "src", "left_anti").select("chain")
        found = over if found is None else found.unionByName(over)
        paths = paths.join(links, "src").filter(~F.array_contains("chain", F.col("dst"))).select(F.concat("chain", F.array("dst")).alias("chain"))
        if not paths.take(1):
            break
    return found


def adjacency(edges: DataFrame, width: int = 1000) -> DataFrame:
    """id, direction (``out``: what it depends on, ``in``: what depends on it), block, first, last, n, neighbours.

    Each node's distinct neighbours in order, cut wherever their place in the order of all links is a
    multiple of ``width``: no row holds more than ``width`` neighbours, and a hub is many rows that many
    tasks make. Blocks count from 0 in each node and direction; first and last say which of them may
    hold a neighbour. Nodes without links have no rows. Rows with a null end go."""
    pairs = edges.select("src", "dst").dropna().distinct()
    both = pairs.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("to")).unionByName(pairs.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("to")))
    placed = numbered(both, ["id", "direction", "to"], "_at").withColumn("_part", F.floor(F.col("_at") / width))
    parts = placed.groupBy("id", "direction", "_part").agg(F.array_sort(F.collect_list("to")).alias("neighbours"))
    starts = parts.groupBy("id", "direction").agg(F.min("_part").alias("_first"))
    out = parts.join(starts, ["id", "direction"])
    return out.select("id", "direction", (F.col("_part") - F.col("_first")).alias("block"), F.get("neighbours", F.lit(0)).alias("first"), F.element_at("neighbours", -1).alias("last"), F.size("neighbours").alias("n"), "neighbours")


def export_blocks(blocks: DataFrame) -> DataFrame:
    """id, direction, block, json of each block of :func:`adjacency`: the JSON form in lines of bounded length."""
    return blocks.select("id", "direction", "block", F.to_json(F.struct("id", "direction", "block", "neighbours")).alias("json"))


def export(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, dependencies, dependents (sorted arrays) and json of every vertex; one row a vertex, so for
    graphs with hubs of millions of links take :func:`adjacency`."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("dependencies"))
    into = pairs.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("dependents"))
    rows = vertices.select("id").distinct().join(out, "id", "left").join(into, "id", "left")
    none = F.array().cast(edges.select(F.array("src").alias("a")).schema["a"].dataType)
    rows = rows.select("id", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))
    return rows.withColumn("json", F.to_json(F.struct("id", "dependencies", "dependents")))
