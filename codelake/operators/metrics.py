"""Measures of symbols, calls and dependencies.

``symbols``: name, type, file_path, parent, is_exported, is_async, decorators, calls, references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.paths import language_of
from ..functions.text import contains_any
from ..functions.words import mentioning, mentions

_CALLABLE = ("function", "method")


def language_counts(files: DataFrame, column: str = "path", table=tables.DIAGRAM_LANGUAGES) -> DataFrame:
    """language, n_files, first_ord (to list languages in the order they are met)."""
    order = F.col("file_ord") if "file_ord" in files.columns else F.lit(0)
    return files.groupBy(language_of(F.col(column), table).alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.min(order).alias("first_ord"))


def coupling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, efferent, afferent, instability (efferent share; 0 for isolated nodes) of every vertex.

    One union of both directions and one aggregation: distinct neighbours are counted after a
    partial distinct, so a hub's edges meet as counts, not rows."""
    pairs = edges.select("src", "dst").distinct()
    both = pairs.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(pairs.select(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    every = both.unionByName(vertices.select("id", F.lit(0).alias("out"), F.lit(0).alias("into")))
    out = every.groupBy("id").agg(F.sum("out").alias("efferent"), F.sum("into").alias("afferent"))
    total = F.col("efferent") + F.col("afferent")
    return out.withColumn("instability", F.when(total > 0, F.col("efferent") / total).otherwise(0.0))


def cohesion(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """module, internal_refs, total_refs, cohesion. ``symbols``: module, name; ``references``: module,
    ref. Without symbols 0, without references 1."""
    names = symbols.select("module", F.col("name").alias("ref")).distinct().withColumn("own", F.lit(1))
    counted = references.groupBy("module", "ref").agg(F.count(F.lit(1)).alias("n"))
    hits = counted.join(names, ["module", "ref"], "left").groupBy("module").agg(F.sum(F.when(F.col("own") == 1, F.col("n")).otherwise(0)).alias("internal_refs"), F.sum("n").alias("total_refs"))
    modules = symbols.select("module").distinct().withColumn("known", F.lit(True))
    out = modules.join(hits, "module", "full_outer")
    refs = F.coalesce("total_refs", F.lit(0))
    value = F.when(F.col("known").isNull(), 0.0).when(refs == 0, 1.0).otherwise(F.col("internal_refs") / refs)
    return out.select("module", F.coalesce("internal_refs", F.lit(0)).alias("internal_refs"), refs.alias("total_refs"), value.alias("cohesion"))


def call_buckets(rows: DataFrame, column: str = "n_calls") -> DataFrame:
    """One row: numbers with up to 3, 7, 15 and more calls."""
    c = F.col(column)
    return rows.agg(F.count_if(c <= 3).alias("simple"), F.count_if((c > 3) & (c <= 7)).alias("moderate"), F.count_if((c > 7) & (c <= 15)).alias("complex"), F.count_if(c > 15).alias("very_complex"))


def cross_references(symbols: DataFrame) -> DataFrame:
    """ref, used_by: each ``file:symbol`` that refers to it, once; rows, as a name may be used everywhere."""
    return symbols.select(F.explode("references").alias("ref"), F.concat_ws(":", "file_path", "name").alias("used_by")).distinct()


def variable_flow(symbols: DataFrame) -> DataFrame:
    """variable, flows_to: sorted references of each variable."""
    rows = symbols.filter(F.col("type") == "variable").select(F.col("name").alias("variable"), F.explode("references").alias("ref"))
    return rows.distinct().groupBy("variable").agg(F.array_sort(F.collect_list("ref")).alias("flows_to"))


def _hits(words: list[str]) -> Column:
    return mentioning(F.col("calls"), words)


def data_sources(symbols: DataFrame, words: list[str] = tables.SOURCE_WORDS) -> DataFrame:
    """Functions with a call that reads."""
    return symbols.filter((F.col("type") == "function") & (F.size(_hits(words)) > 0)).select("file_path", "name")


def data_sinks(symbols: DataFrame, words: list[str] = tables.SINK_WORDS) -> DataFrame:
    """Functions with a call that writes."""
    return data_sources(symbols, words)


def error_handling(symbols: DataFrame, words: list[str] = tables.ERROR_WORDS) -> DataFrame:
    """name, calls: the sorted calls of functions and methods of a name that deal with errors."""
    rows = symbols.filter(F.col("type").isin(*_CALLABLE)).select("name", F.explode(_hits(words)).alias("call"))
    return rows.distinct().groupBy("name").agg(F.array_sort(F.collect_list("call")).alias("calls"))


def async_patterns(symbols: DataFrame, words: list[str] = tables.ASYNC_WORDS) -> DataFrame:
    """name, patterns: ``async_function`` for async symbols or names, and the matching calls."""
    mark = F.when(F.coalesce("is_async", F.lit(False)) | mentions(F.lower("name"), words), F.array(F.lit("async_function"))).otherwise(F.array().cast("array<string>"))
    rows = symbols.select("name", F.explode(F.concat(mark, F.coalesce(_hits(words), F.array().cast("array<string>")))).alias("p"))
    return rows.distinct().groupBy("name").agg(F.array_sort(F.collect_list("p")).alias("patterns"))


def api_boundary(symbols: DataFrame) -> DataFrame:
    return symbols.filter("is_exported")


def design_patterns(symbols: DataFrame) -> DataFrame:
    """pattern, name of each member: singleton (a class with a method of its own that names an
    instance), factory (by prefix), observer (by word), decorator (decorated, or by word)."""
    low = F.lower("name")
    owners = symbols.filter((F.col("type") == "method") & F.contains(low, F.lit("instance"))).select(F.col("parent").alias("name")).distinct()
    singleton = symbols.filter(F.col("type") == "class").join(owners, "name", "left_semi").select(F.lit("singleton").alias("pattern"), "name")
    starts = F.lit(False)
    for p in tables.FACTORY_PREFIXES:
        starts = starts | F.startswith(low, F.lit(p))
    callable_ = F.col("type").isin(*_CALLABLE)
    labels = F.array_compact(
        F.array(
            F.when(callable_ & starts, F.lit("factory")),
            F.when(callable_ & contains_any(low, tables.OBSERVER_WORDS), F.lit("observer")),
            F.when((F.coalesce(F.size("decorators"), F.lit(0)) > 0) | contains_any(low, tables.DECORATOR_WORDS), F.lit("decorator")),
        )
    )
    rest = symbols.select(F.explode(labels).alias("pattern"), "name")
    return singleton.unionByName(rest).distinct()
