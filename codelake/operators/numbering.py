"""Positions in one global order, without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def _offset(sums: list[int]) -> Column:
    """The sum over all earlier ranges, by the number of the range."""
    before = [0, *accumulate(sums)][: max(1, len(sums))]
    return F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_range"))


def numbered(df: DataFrame, order: list[str], name: str = "number", weight: str | None = None) -> DataFrame:
    """``df`` with its 0-based position in ``order`` and, with ``weight``, the column ``<weight>_before``:
    the sum of the weights of all rows that come earlier.

    Rows are dealt to ranges of the order and written once, as the bounds of the ranges are sampled
    and must not change afterwards; only a count and a sum for each range reach the driver. The order
    should tell rows apart: rows that are equal in it are numbered among themselves in any way. Nulls
    come first. No rows: none. The columns ``_range`` and ``_row`` must not occur in ``df``."""
    s = Scratch(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = s.result(dealt.select("*", F.shiftright(at, 33).cast("int").alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_row")))
    total = F.sum(weight) if weight else F.lit(0)
    found = {r["_range"]: (r["n"], r["w"]) for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), total.alias("w")).collect()}
    sums = [found.get(i, (0, 0)) for i in range(max(found, default=-1) + 1)]
    out = rows.withColumn(name, F.col("_row") + _offset([n for n, _ in sums]))
    if weight:
        earlier = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        own = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
        out = out.withColumn(f"{weight}_before", own + _offset([w or 0 for _, w in sums]))
    return out.drop("_range", "_row")
