"""Usage examples from the fact tables: title, description, code, language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, tables
from ..functions.text import contains_any
from ..sources.extract.python import main_block
from .rank import until_reached


def signature_stub(name: Column, signature: Column, description: Column) -> Column:
    """A definition with its description above."""
    head = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit('"""'), F.substring(description, 1, 100), F.lit('"""\n'))).otherwise("")
    return F.concat(head, F.lit("def "), name, signature, F.lit(":\n    # Function implementation"))


def decorated_stub(name: Column, signature: Column, description: Column, decorators: Column) -> Column:
    """A definition with at most two decorators."""
    marks = F.array_join(F.transform(F.slice(decorators, 1, 2), lambda d: F.concat(F.lit("@"), d, F.lit("\n"))), "")
    doc = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit('    """'), F.substring(description, 1, 100), F.lit('"""\n'))).otherwise("")
    return F.concat(marks, F.lit("def "), name, signature, F.lit(":\n"), doc, F.lit("    # Implementation"))


def main_code(content: Column) -> Column:
    """The body of the main block of Python source, in batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: main_block(t or ""))

    return run(content)


def _no_test() -> Column:
    return ~F.contains(F.lower("path"), F.lit("test"))


def usage(files: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """Main blocks, and functions that are called an example; the first ``most`` in file order."""
    blocks = files.filter(_no_test() & (F.col("language") == "python")).withColumn("code", main_code(F.col("content"))).filter("code is not null")
    blocks = blocks.select("file_ord", F.lit(-1).alias("ord"), F.lit("Basic Usage").alias("title"), F.concat(F.lit("Example from "), paths.name_of(F.col("path"))).alias("description"), "code", F.lit("python").alias("language"))
    named = symbols.filter(_no_test() & F.col("class_name").isNull() & contains_any(F.lower("name"), tables.EXAMPLE_WORDS))
    named = named.select("file_ord", "ord", F.concat(F.lit("Example: "), F.col("name")).alias("title"), "description", signature_stub(F.col("name"), F.col("signature"), F.col("description")).alias("code"), F.lit("python").alias("language"))
    return blocks.unionByName(named).orderBy("file_ord", "ord").limit(most)


def api(symbols: DataFrame, enough: int = 3) -> DataFrame:
    """Decorated handlers in API files, up to and with the file that makes it ``enough``."""
    hit = F.exists("decorators", lambda d: contains_any(F.lower(d), tables.API_DECORATOR_WORDS))
    rows = symbols.filter(F.col("class_name").isNull() & contains_any(F.lower("path"), tables.API_PATH_WORDS) & hit)
    rows = rows.select("file_ord", "ord", F.concat(F.lit("API Endpoint: "), F.col("name")).alias("title"), F.coalesce("description", F.lit("API endpoint handler")).alias("description"), decorated_stub(F.col("name"), F.col("signature"), F.col("description"), F.col("decorators")).alias("code"), F.lit("python").alias("language"))
    return until_reached(rows, "file_ord", "ord", enough)


def cli(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """The first function of each file with a command-line library that names a command; if there
    are none, how to run the first main file."""
    users = imports.filter(contains_any(F.lower(F.concat_ws(" ", "module", "name", "alias")), tables.CLI_IMPORT_WORDS)).select("path").distinct()
    hit = contains_any(F.lower("name"), tables.CLI_FUNCTION_WORDS) | contains_any(F.lower(F.coalesce("description", F.lit(""))), tables.CLI_FUNCTION_WORDS)
    rows = symbols.filter(F.col("class_name").isNull() & hit).join(users, "path", "left_semi")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).filter("_n = 1")
    found = rows.select("file_ord", F.concat(F.lit("CLI: "), F.col("name")).alias("title"), F.coalesce("description", F.lit("Command-line interface")).alias("description"), signature_stub(F.col("name"), F.col("signature"), F.col("description")).alias("code"), F.lit("python").alias("language"))
    mains = files.filter(F.contains("path", F.lit("main.py"))).orderBy("file_ord").limit(1)
    plain = mains.select("file_ord", F.lit("Running the Application").alias("title"), F.lit("Basic command to run the application").alias("description"), F.concat(F.lit("python "), paths.name_of(F.col("path"))).alias("code"), F.lit("bash").alias("language"))
    any_found = found.agg(F.count(F.lit(1)).alias("_k"))
    fallback = plain.join(F.broadcast(any_found)).filter("_k = 0").drop("_k")  # one row at most on either side
    return found.unionByName(fallback).orderBy("file_ord")


def import_lines(summaries: DataFrame, symbols: DataFrame, classes: DataFrame, most: int = 3) -> DataFrame:
    """How to import from the first files with a class or three functions: two classes, else the public
    ones of the first three functions."""
    main = summaries.filter(_no_test() & ~F.contains("path", F.lit("__init__")) & ((F.col("n_classes") > 0) | (F.col("n_functions") >= 3))).orderBy("file_ord").limit(most)
    chosen = F.broadcast(main.select("path"))
    names = lambda rows, n, alias: rows.join(chosen, "path", "left_semi").groupBy("path").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "name"))), 1, n), lambda x: x["name"]).alias(alias))
    found = main.join(names(classes, 2, "cs"), "path", "left").join(names(symbols.filter("class_name is null"), 3, "fs"), "path", "left")
    public = F.filter("fs", lambda f: ~F.startswith(f, F.lit("_")))
    what = F.when(F.size("cs") > 0, F.col("cs")).otherwise(public)
    module = F.regexp_replace(paths.name_of(F.col("path")), r"\.\w+$", "")
    out = found.withColumns({"what": what, "module": module}).filter(F.size("what") > 0)
    return out.select("file_ord", F.concat(F.lit("Importing from "), F.col("module")).alias("title"), F.concat(F.lit("How to import and use "), F.col("module"), F.lit(" module")).alias("description"), F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.array_join("what", ", ")).alias("code"), F.lit("python").alias("language")).orderBy("file_ord")
