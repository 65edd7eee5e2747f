"""Facts about a project: classifications by word tables, and sums over its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, tables
from ..functions.text import contains_any
from ..functions.words import CHAIN, found, mentions


def first_match(c: Column, table: list[tuple[str, str]], other: Column) -> Column:
    """The value of the first word that the string contains: a chain of conditions, without a join."""
    for word, value in reversed(table):
        other = F.when(F.contains(c, F.lit(word)), value).otherwise(other)
    return other


def is_test(path: Column, word: str = "test") -> Column:
    """True if the file name contains the word in any case."""
    return F.contains(F.lower(paths.name_of(path)), F.lit(word))


def entry_points(files: DataFrame, main=tables.MAIN_FILES, cli=tables.CLI_FILES, api=tables.API_WORDS, guards=tables.MAIN_GUARDS) -> DataFrame:
    """path, ord, type, description; a file may have several types. ``executable`` only if it has no other.

    ``files``: path, file_ord, summary."""
    name, text = paths.name_of(F.col("path")), F.coalesce("summary", F.lit(""))
    label = lambda hit, i, kind, title: F.when(hit, F.struct(F.lit(i).alias("label_ord"), F.lit(kind).alias("type"), F.concat(F.lit(title + ": "), name).alias("description")))
    named = F.array_compact(F.array(label(name.isin(*main), 0, "main", "Main entry point"), label(name.isin(*cli), 1, "cli", "Command-line interface"), label(contains_any(F.lower(name), api), 2, "api", "API server")))
    guarded = F.array_compact(F.array(label(contains_any(text, guards), 3, "executable", "Executable script")))
    return files.select("path", "file_ord", F.inline(F.when(F.size(named) > 0, named).otherwise(guarded)))


def architecture(files: DataFrame, root: str | None = None) -> DataFrame:
    """One row: primary_pattern, description, patterns (array) and confidence (map).

    Votes over the distinct directory names of all files, relative to ``root``. The best confidence
    wins, the first in table order among equals; ``Custom`` if nothing votes."""
    path = paths.relative(F.col("path"), root) if root else F.col("path")
    parts = paths.segments(paths.directory_of(path))
    low = F.lower(path)
    per_file = files.select(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(None).cast("string"))).alias("parts"), contains_any(low, ["dockerfile", "docker-compose"]).cast("int").alias("docker"), contains_any(low, ["main", "app", "server"]).cast("int").alias("served"))
    counts = per_file.agg(F.sum("docker").alias("docker"), F.sum("served").alias("served"))
    names = per_file.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    has = lambda words: F.coalesce(F.max(F.col("part").isin(*words)), F.lit(False))
    votes = names.agg(
        F.count("part").alias("parts"),
        has(tables.MVC_DIRS).alias("mvc"), has(tables.LAYER_DIRS).alias("layered"), has(tables.CLEAN_DIRS).alias("clean"), has(tables.MODULE_DIRS).alias("modules"),
        F.count_if(F.contains("part", F.lit("service"))).alias("services"),
    )
    one = votes.join(F.broadcast(counts))  # one row each
    yes = [F.col("mvc"), F.col("layered"), F.col("clean"), (F.col("services") > 1) | ((F.coalesce("docker", F.lit(0)) > 1) & (F.coalesce("served", F.lit(0)) > 2)), (F.col("parts") > 5) & F.col("modules"), F.col("parts") <= 3]
    found = F.array_compact(F.array(*[F.when(y, F.struct((-F.lit(c)).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(d).alias("text"))) for i, (y, (n, c, d)) in enumerate(zip(yes, tables.ARCHITECTURES, strict=True))]))
    best = F.get(F.array_sort(found), F.lit(0))
    return one.select(
        F.coalesce(best["name"], F.lit(tables.NO_ARCHITECTURE[0])).alias("primary_pattern"),
        F.coalesce(best["text"], F.lit(tables.NO_ARCHITECTURE[1])).alias("description"),
        F.transform(found, lambda x: x["name"]).alias("patterns"),
        F.map_from_arrays(F.transform(found, lambda x: x["name"]), F.transform(found, lambda x: -x["c"])).alias("confidence"),
    )


def directory_rollup(files: DataFrame, column: str = "path") -> DataFrame:
    """dir, depth, parent, n_files, first_ord: each file counts in every directory above it.

    The prefixes are made inside the row and summed before the shuffle."""
    order = F.col("file_ord") if "file_ord" in files.columns else F.lit(0)
    ups = files.select(order.alias("o"), F.explode(paths.ancestors(F.col(column))).alias("dir"))
    out = ups.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.min("o").alias("first_ord"))
    return out.select("dir", F.size(F.split("dir", "/")).alias("depth"), paths.directory_of(F.col("dir")).alias("parent"), "n_files", "first_ord")


def directory_purpose(directory: Column, n_files: Column, table: list[tuple[str, str]] = tables.PURPOSES) -> Column:
    """What a directory is for: by the first word in its lower-cased name."""
    return first_match(F.lower(directory), table, F.concat(F.lit("Contains "), n_files.cast("string"), F.lit(" file(s)")))


def module_tree(files: DataFrame) -> DataFrame:
    """dir, name, path, n_functions, n_classes, n_imports: the flat form of the module tree."""
    return files.select(paths.directory_of(F.col("path")).alias("dir"), paths.name_of(F.col("path")).alias("name"), "path", "n_functions", "n_classes", "n_imports")


def nested_tree(rows: list[dict]) -> dict:
    """The module tree as nested dictionaries, from collected rows of :func:`module_tree`."""
    out: dict = {}
    for r in rows:
        at = out
        for part in [p for p in r["dir"].split("/") if p]:
            at = at.setdefault(part, {})
        at[r["name"]] = {"functions": r["n_functions"], "classes": r["n_classes"], "imports": r["n_imports"]}
    return out


def keyword_features(names: DataFrame, column: str = "name", table: list[tuple[str, list[str]]] = tables.FEATURES) -> DataFrame:
    """ord, feature for every feature of which a word occurs in some name; one aggregation, one row out of a task."""
    low = F.lower(F.col(column))
    hits = names.agg(*[F.coalesce(F.max(mentions(low, words)), F.lit(False)).alias(f"f{i}") for i, (_, words) in enumerate(table)])
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("feature"), F.col(f"f{i}").alias("hit")) for i, (name, _) in enumerate(table)])
    return hits.select(F.inline(each)).filter("hit").drop("hit")


def frameworks(imports: DataFrame, words: list[str] = tables.FRAMEWORKS) -> DataFrame:
    """name of each framework that some import mentions, sorted."""
    text = F.lower(F.concat_ws(" ", "module", "name", "alias"))
    if len(words) <= CHAIN:
        hits = imports.select(F.explode(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))).alias("name"))
        return hits.distinct().orderBy("name")
    table = imports.sparkSession.createDataFrame(list(enumerate(words)), "i int, name string")
    return imports.select(F.explode(found(text, words)).alias("i")).distinct().join(F.broadcast(table), "i").select("name").distinct().orderBy("name")


def test_framework(import_text: Column, words: list[str] = tables.TEST_FRAMEWORKS) -> Column:
    """The first test framework that an import mentions, else null."""
    return first_match(F.lower(import_text), [(w, w) for w in words], F.lit(None).cast("string"))


def project_languages(files: DataFrame, table=tables.LANGUAGE_SUFFIXES) -> DataFrame:
    """Distinct languages by suffix, sorted."""
    return files.select(paths.language_of(F.col("path"), table, None).alias("language")).filter("language is not null").distinct().orderBy("language")


def import_kind(module: Column, level: Column | None = None, stdlib: list[str] = tables.STDLIB, own: Column | None = None) -> Column:
    """``internal``, ``stdlib`` or ``external``. Relative imports and modules of the project
    (``own``) are internal; without ``level`` and ``own`` only the spelling decides."""
    base = F.lower(F.get(F.split(module, r"\."), F.lit(0)))
    inner = F.startswith(module, F.lit(".")) | F.startswith(module, F.lit("src.")) | F.contains(module, F.lit("/"))
    if level is not None:
        inner = inner | (F.coalesce(level, F.lit(0)) > 0)
    if own is not None:
        inner = inner | F.coalesce(own, F.lit(False))
    return F.when(inner, "internal").when(base.isin(*stdlib), "stdlib").otherwise("external")


def classified_imports(imports: DataFrame, files: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """``imports`` with kind, package (the first part of the module) and, unless ``compat``, with
    the project's own modules (joined by dotted path) as internal."""
    out = imports
    if files is not None and not compat:
        dotted = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.\w+$", ""), "/", ".")
        parts = F.split(dotted, r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
        modules = files.select(F.explode(tails).alias("module")).distinct().withColumn("own", F.lit(True))
        out = out.join(modules, "module", "left")
        kind = import_kind(F.col("module"), F.col("level"), own=F.col("own"))
    else:
        kind = import_kind(F.col("module"))
    return out.withColumns({"kind": kind, "package": F.get(F.split("module", r"\."), F.lit(0))}).drop("own")


def dependency_summary(classified: DataFrame) -> DataFrame:
    """One row: sorted distinct external and stdlib packages, n_internal (distinct by file), most_used."""
    used = classified.groupBy("kind", "package", F.when(F.col("kind") == "internal", F.col("path")).alias("path"), F.when(F.col("kind") == "internal", F.col("module")).alias("module")).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("package"))))
    best = F.min(F.when(F.col("kind") == "external", F.struct((-F.col("n")).alias("n"), F.col("package").alias("package"))))
    return used.agg(pick("external").alias("external_packages"), pick("stdlib").alias("stdlib_packages"), F.count_if(F.col("kind") == "internal").alias("n_internal"), best["package"].alias("most_used"))


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value and its count; the first by name among equals."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)


def file_statistics(files: DataFrame, spans: DataFrame) -> DataFrame:
    """One row of totals. ``files``: n_functions, n_classes; ``spans``: start, end of top-level
    functions and classes. estimated_lines sums end - start where both are there and not 0."""
    totals = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("n_functions"), F.lit(0)).alias("total_functions"), F.coalesce(F.sum("n_classes"), F.lit(0)).alias("total_classes"))
    lines = spans.filter("start <> 0 and `end` <> 0").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("estimated_lines"))
    one = totals.join(F.broadcast(lines))  # one row each
    per = lambda c: F.when(F.col("total_files") > 0, F.round(F.col(c) / F.col("total_files"), 2)).otherwise(0.0)
    return one.select("*", per("total_functions").alias("functions_per_file"), per("total_classes").alias("classes_per_file"))


def complexity_level(average: Column) -> Column:
    return F.when(average.isNull(), "Unknown").when(average < 5, "Low").when(average < 10, "Moderate").otherwise("High")


def complexity_overview(rows: DataFrame, column: str = "cyclomatic", by: list[str] | None = None) -> DataFrame:
    """avg_complexity, max_complexity, n_measured and level over non-zero values; the level looks at
    the unrounded mean."""
    value = F.when(F.col(column) != 0, F.col(column))
    out = rows.groupBy(*(by or [])).agg(F.avg(value).alias("_a"), F.max(value).alias("max_complexity"), F.count(value).alias("n_measured"))
    return out.select(*(by or []), F.round("_a", 2).alias("avg_complexity"), "max_complexity", "n_measured", complexity_level(F.col("_a")).alias("level"))


def testing_summary(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: test_count, frameworks (sorted), ratio as ``n/total files``."""
    counts = files.agg(F.count_if(is_test(F.col("path"))).alias("test_count"), F.count(F.lit(1)).alias("_n"))
    of_tests = imports.filter(is_test(F.col("path")))
    names = of_tests.agg(F.array_sort(F.collect_set(test_framework(F.concat_ws(" ", "module", "name")))).alias("frameworks"))
    one = counts.join(F.broadcast(names))  # one row each
    return one.select("test_count", "frameworks", F.concat(F.col("test_count").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(" files")).alias("ratio"))
