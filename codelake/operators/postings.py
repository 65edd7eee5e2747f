"""A searchable cross-reference index: posting lists in blocks.

Users of references are numbered in the order of their names. The numbers are cut into cells of
``CELL``; a reference has one block for each cell that holds some of its users, as sorted gaps.
So a block is bounded whatever a reference's number of users, a name used everywhere is many rows
that many tasks share, and the columns (ref, cell, n) are the skip entries: a search reads the gaps of
those cells alone in which every wanted reference has a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered
from .scratch import Scratch

CELL = 1024


def _gaps(offsets: Column) -> Column:
    """Sorted offsets as the first one and the differences to the one before."""
    return F.transform(offsets, lambda x, i: (x - F.when(i > 0, F.get(offsets, i - 1)).otherwise(F.lit(0))).cast("smallint"))


def _offsets(gaps: Column) -> Column:
    """Running sums of the gaps."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    step = lambda a, g: F.struct(F.concat(a["out"], F.array(a["at"] + g)).alias("out"), (a["at"] + g).alias("at"))
    return F.aggregate(gaps, start, step, lambda a: a["out"])


def _numbers(rows: DataFrame, key: str, offsets: Column) -> DataFrame:
    """key, number: one row for each offset in each cell."""
    return rows.select(key, "cell", F.explode(offsets).alias("_at")).select(key, (F.col("cell") * CELL + F.col("_at")).alias("number"))


def users(references: DataFrame) -> DataFrame:
    """number, used_by: the distinct users, numbered from 0 in the order of their names."""
    return numbered(references.filter("used_by is not null").select("used_by").distinct(), ["used_by"]).select("number", "used_by")


def blocks(references: DataFrame, named: DataFrame) -> DataFrame:
    """ref, cell, n, gaps: the posting lists of ``references(ref, used_by)``, users numbered by ``named``.

    Repeated rows count once; rows with a null go. No rows: no blocks."""
    pairs = references.select("ref", "used_by").filter("ref is not null").join(named, "used_by").select("ref", "number").distinct()
    cells = pairs.groupBy("ref", F.floor(F.col("number") / CELL).alias("cell")).agg(F.array_sort(F.collect_list((F.col("number") % CELL).cast("int"))).alias("_at"))
    return cells.select("ref", "cell", F.size("_at").alias("n"), _gaps(F.col("_at")).alias("gaps"))


def write(references: DataFrame, path: str) -> None:
    """The index as two tables, ``<path>/users`` by number and ``<path>/blocks`` by reference and cell, each
    sorted, so that the file statistics rule out what a search doesn't want."""
    named = users(references)
    by = ["ref", "cell"]
    named.repartitionByRange("number").sortWithinPartitions("number").write.mode("overwrite").parquet(f"{path}/users")
    blocks(references, named).repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users, blocks) of a written index."""
    return spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/blocks")


def postings(index: DataFrame) -> DataFrame:
    """ref, number: the blocks spelled out."""
    return _numbers(index, "ref", _offsets(F.col("gaps")))


def counts(index: DataFrame) -> DataFrame:
    """ref, n_users, from the skip entries alone."""
    return index.groupBy("ref").agg(F.sum("n").alias("n_users"))


def shared_cells(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, ref, cell: blocks in cells where each reference of a query has one; reads no gaps."""
    asked = wanted.select("query", "ref").distinct()
    many = asked.groupBy("query").agg(F.count(F.lit(1)).alias("_k"))
    met = index.select("ref", "cell").join(asked, "ref")
    full = met.groupBy("query", "cell").agg(F.count(F.lit(1)).alias("_n")).join(many, "query").filter("_n = _k").select("query", "cell")
    return met.join(full, ["query", "cell"], "left_semi").select("query", "ref", "cell")


def search(index: DataFrame, wanted: DataFrame, named: DataFrame) -> DataFrame:
    """query, used_by: the users of all references of each query in ``wanted(query, ref)``.

    Any number of queries at once. Cells in which some reference has no block are ruled out by the
    skip entries; in the others, the blocks of one (query, cell) meet in one row and are intersected.
    A query or reference that is null finds nothing, nor does one that asks for an unknown reference;
    repeated rows of ``wanted`` count once."""
    asked = Scratch(index.sparkSession).result(shared_cells(index, wanted))
    lists = index.select("ref", "cell", "gaps").join(asked, ["ref", "cell"]).groupBy("query", "cell").agg(F.collect_list("gaps").alias("_lists"))
    first = _offsets(F.get("_lists", F.lit(0)))
    both = F.aggregate(F.slice("_lists", 2, F.greatest(F.size("_lists") - 1, F.lit(0))), first, lambda a, g: F.array_intersect(a, _offsets(g)))
    return _numbers(lists, "query", both).join(named, "number").select("query", "used_by")
