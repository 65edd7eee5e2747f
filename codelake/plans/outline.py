"""What the most important files hold, as one row for each fact.

An outline is a table: the file's place, a kind of fact, its order and its wording. Each kind of a file is cut
to ``facts`` rows before the shuffle, so an outline has a bounded number of rows, whatever the project's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import rank

KINDS = ("file", "class", "field", "method", "function", "use")


def _said(text: Column, width: int) -> Column:
    """`` - text`` cut to ``width``, or nothing."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" - "), F.left(bare, F.lit(width))))


def outline(summaries: DataFrame, classes: DataFrame, symbols: DataFrame, variables: DataFrame, imports: DataFrame, files: int = 10, facts: int = 8, width: int = 120) -> DataFrame:
    """place (of the file, from 1), path, kind (one of ``KINDS``), ord, fact."""
    top = rank.top_files(summaries, files)
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "file_ord")  # ``files`` rows
    chosen = F.broadcast(top.select("path", F.row_number().over(best).alias("place")))

    def facts_of(kind: str, rows: DataFrame, order: str, fact: Column) -> DataFrame:
        rows = rows.join(chosen, "path").select("place", "path", F.lit(kind).alias("kind"), F.col(order).cast("long").alias("ord"), fact.alias("fact"))
        return rank.first_per_group(rows, ["path"], [F.col("ord"), F.col("fact")], facts).drop("rank")

    of = F.concat(F.coalesce(F.concat(F.col("class_name"), F.lit(".")), F.lit("")), "name", F.coalesce("signature", F.lit("")))
    gives = F.when(F.coalesce("returns.type", F.lit("")) == "", "").otherwise(F.concat(F.lit(" gives "), F.col("returns.type")))
    called = F.concat(F.lit("`"), of, F.lit("`"), gives, _said(F.col("description"), width))
    public = symbols.filter(~F.startswith("name", F.lit("_")))
    base = F.when(F.coalesce("extends", F.lit("")) == "", "").otherwise(F.concat(F.lit(" from "), F.col("extends")))
    parts = [
        facts_of("file", top.select("path", "summary", F.lit(0).alias("ord")), "ord", F.concat(F.lit("`"), F.col("path"), F.lit("`"), _said(F.col("summary"), 2 * width))),
        facts_of("class", classes, "ord", F.concat(F.lit("`"), F.col("name"), F.lit("`"), base, F.format_string(", %s methods", F.col("n_methods").cast("string")), _said(F.col("description"), width))),
        facts_of("field", variables.filter("kind = 'attribute'"), "line", F.concat(F.lit("`"), F.col("owner"), F.lit("."), F.col("name"), F.lit("`"))),
        facts_of("method", public.filter("class_name is not null"), "ord", called),
        facts_of("function", public.filter("class_name is null"), "ord", called),
        facts_of("use", imports.groupBy("path", "module", "kind").agg(F.min("line").alias("line")), "line", F.concat(F.lit("`"), F.col("module"), F.lit("` ("), F.col("kind"), F.lit(")"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def text(rows: DataFrame, heading: str = "###") -> DataFrame:
    """One row, ``content``: an outline as Markdown, a heading for each file and a list below it."""
    line = F.when(F.col("kind") == "file", F.concat(F.lit(f"\n{heading} "), "fact", F.lit("\n"))).otherwise(F.concat(F.lit("- "), "kind", F.lit(" "), "fact"))
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    ordered = F.array_sort(F.collect_list(F.struct("place", nth.alias("nth"), "ord", line.alias("line"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))
