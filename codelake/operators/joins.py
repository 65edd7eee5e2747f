"""Merges of rows by name: left and full outer joins with a choice for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``; an aggregate, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


def keep_last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same by a window, for rows with columns that cannot be compared."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_declared(declared: DataFrame, documented: DataFrame, keys: list[str], order: str = "ord", default_type: str = "", compat: bool = False) -> DataFrame:
    """Declared parameters with their documentation, a left outer join on ``keys`` and ``name``.

    Both sides: keys, name, type, default, description, optional; the documented side also ``order``,
    by which the last row of a name wins; blank names there are dropped. ``type`` is the
    documented one if there is one; ``optional`` holds if either says so. ``default`` is the documented
    one, else the declared one; with ``compat`` a documented row decides even when it has none."""
    docs = documented.filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    docs = last_wins(docs.select(*keys, "name", "type", "default", "description", "optional", order), [*keys, "name"], [order])
    docs = docs.select(*keys, "name", *[F.col(c).alias(f"_{c}") for c in ("type", "default", "description", "optional")], F.lit(True).alias("_there"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    default = F.when(F.col("_there"), F.col("_default")).otherwise(F.col("default")) if compat else F.coalesce("_default", "default")
    joined = declared.join(docs, [*keys, "name"], "left")
    rest = [c for c in declared.columns if c not in (*keys, "name", "type", "default", "description", "optional")]
    return joined.select(
        *keys, "name", *rest,
        F.coalesce(filled("_type"), filled("type"), F.lit(default_type)).alias("type"),
        default.alias("default"),
        F.coalesce(filled("_description"), F.col("description"), F.lit("")).alias("description"),
        (F.coalesce("optional", F.lit(False)) | F.coalesce("_optional", F.lit(False))).alias("optional"),
    )


def merge_drafts(base: DataFrame, refined: DataFrame, keys: list[str], text: str = "desc", factor: float = 1.2) -> DataFrame:
    """Full outer join of two drafts on ``keys``: where both are, the refined row if its ``text`` is
    longer than ``factor`` times the base one; ``origin`` tells which."""
    rest = [c for c in base.columns if c not in keys]
    b = base.select(*keys, F.struct(*rest).alias("_b"))
    r = refined.select(*keys, F.struct(*rest).alias("_r"))
    size = lambda c: F.length(F.coalesce(F.col(c)[text], F.lit("")))
    take_refined = F.col("_b").isNull() | (F.col("_r").isNotNull() & (size("_r") > factor * size("_b")))
    best = F.when(take_refined, F.col("_r")).otherwise(F.col("_b"))
    out = b.join(r, keys, "full_outer").withColumns({"_v": best, "origin": F.when(take_refined, "refined").otherwise("base")})
    return out.select(*keys, *[F.col("_v")[c].alias(c) for c in rest], "origin")


def pick_by_score(base: Column, refined: Column, base_score: Column, refined_score: Column, refined_has: Column, margin: float = 0.1) -> Column:
    """The refined value if it scores more by the margin, or the base one does not and it has content."""
    better = (refined_score > base_score + margin) | (~(base_score > refined_score + margin) & refined_has)
    return F.when(better, refined).otherwise(base)


def existing_edges(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """Distinct edges whose two ends exist."""
    known = vertices.select(key).distinct()
    return edges.join(known.withColumnRenamed(key, "src"), "src", "left_semi").join(known.withColumnRenamed(key, "dst"), "dst", "left_semi").select(*edges.columns).distinct()
