"""Diagrams as text: rows of lines with an order, joined by one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, tables
from ..functions.text import contains_any, escape_label
from ..operators.metrics import language_counts
from ..operators.rank import capped_edges, first_per_group, folder_nodes, largest, top_and_other


def lines_to_text(lines: DataFrame, order: list[str], head: str | list[str], empty: str | None = None, fence: bool = True) -> DataFrame:
    """One row: ``content``, the head and then column ``line`` in order. ``empty`` stands in for no line."""
    head = [head] if isinstance(head, str) else head
    got = lines.agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("l"))
    body = F.transform("l", lambda x: x["line"])
    if empty is not None:
        body = F.when(F.size("l") == 0, F.array(F.lit(empty))).otherwise(body)
    parts = F.concat(F.array(*[F.lit(h) for h in (["```mermaid"] if fence else []) + head]), body, F.array(F.lit("```")) if fence else F.array().cast("array<string>"))
    return got.select(F.array_join(parts, "\n").alias("content"))


def node_id(c: Column) -> Column:
    return F.translate(c, "- ", "__")


# The components and arrows of a diagram by pattern; % is the entry.
_MVC = ['    Model["📊 Model Layer"]', '    View["👁️ View Layer"]', '    Controller["🎮 Controller Layer"]', "    Entry0 --> Controller", "    Controller --> Model", "    Controller --> View", "    Model --> View"]
_API = ['    Model["📊 Model Layer"]', '    Controller["🎮 Controller Layer"]', "    Entry0 --> Controller", "    Controller --> Model"]
_LAYERED = ['    Presentation["🖥️ Presentation Layer"]', '    Business["💼 Business Logic"]', '    Data["💾 Data Layer"]', "    Entry0 --> Presentation", "    Presentation --> Business", "    Business --> Data"]
_CORE = ['    Core["⚙️ Core Logic"]', '    Utils["🔧 Utilities"]', '    Data["💾 Data Layer"]']
_CORE_ARROWS = ["    Core --> Utils", "    Core --> Data"]


def architecture(entry_points: DataFrame, pattern: DataFrame, dirs: DataFrame, most: int = 3) -> DataFrame:
    """Entries (the first ones), then the components of the pattern. An API without views has no view
    layer. ``Entry0`` is only referred to if there is an entry."""
    first = entry_points.orderBy("file_ord", "label_ord").limit(most)
    ordered = first.agg(F.array_sort(F.collect_list(F.struct("file_ord", "label_ord", "path", "type"))).alias("e"))
    kinds = entry_points.agg(F.coalesce(F.max(F.col("type") == "api"), F.lit(False)).alias("api"))
    views = dirs.agg(F.coalesce(F.max(contains_any(F.lower("dir"), ["view", "template", "static"])), F.lit(False)).alias("views"))
    one = ordered.join(F.broadcast(kinds)).join(F.broadcast(views)).join(F.broadcast(pattern.select("primary_pattern")))  # one row each
    entries = F.transform("e", lambda x, i: F.concat(F.lit("    Entry"), i.cast("string"), F.lit('["'), paths.tail(x["path"], 2), F.lit("<br/>("), x["type"], F.lit(')"]')))
    there = F.size("e") > 0
    rows = lambda some: F.filter(F.array(*[F.lit(s) for s in some]), lambda s: there | ~F.contains(s, F.lit("Entry0")))
    core = F.concat(rows(_CORE), rows(["    Entry0 --> Core"]), rows(_CORE_ARROWS))
    name = F.col("primary_pattern")
    body = F.when(name == "MVC", F.when(F.col("api") & ~F.col("views"), rows(_API)).otherwise(rows(_MVC))).when(name == "Layered", rows(_LAYERED)).otherwise(core)
    return one.select(F.array_join(F.concat(F.array(F.lit("```mermaid"), F.lit("graph TD")), entries, body, F.array(F.lit("```"))), "\n").alias("content"))


def dependencies(edges: DataFrame, most: int = 15, per_node: int = 3) -> DataFrame:
    """Modules and their internal imports, ``edges(src, dst)`` by name."""
    shown = capped_edges(edges, per_node, most)
    names = shown.select(F.col("src").alias("n")).unionByName(shown.select(F.col("dst").alias("n"))).distinct()
    nodes = names.select(F.lit(0).alias("a"), F.col("n").alias("b"), F.lit("").alias("c"), F.concat(F.lit("    "), node_id(F.col("n")), F.lit('["'), F.col("n"), F.lit('"]')).alias("line"))
    arrows = shown.select(F.lit(1).alias("a"), F.col("src").alias("b"), F.col("dst").alias("c"), F.concat(F.lit("    "), node_id(F.col("src")), F.lit(" --> "), node_id(F.col("dst"))).alias("line"))
    return lines_to_text(nodes.unionByName(arrows), ["a", "b", "c"], "graph LR", '    NoDepends["No internal dependencies detected"]')


def class_diagram(classes: DataFrame, symbols: DataFrame, variables: DataFrame, most: int = 8, members: int = 5) -> DataFrame:
    """The first classes with their first attributes and public methods, and the first base of each."""
    shown = classes.orderBy("file_ord", "ord").limit(most).select("path", F.col("name").alias("cls"), "extends", F.col("file_ord").alias("o"), F.col("ord").alias("p"))
    key = ["o", "p"]
    attributes = shown.join(variables.filter("kind = 'attribute'").select("path", F.col("owner").alias("cls"), "name", "type", "line"), ["path", "cls"])
    attributes = first_per_group(attributes, key, [F.col("line"), F.col("name")], members).select("o", "p", F.lit(1).alias("q"), F.col("rank").alias("r"), F.concat(F.lit("        +"), "type", F.lit(" "), "name").alias("line"))
    methods = shown.join(symbols.filter("class_name is not null").select("path", F.col("class_name").alias("cls"), "name", F.col("returns.type").alias("rt"), "ord"), ["path", "cls"])
    methods = first_per_group(methods, key, [F.col("ord")], members).filter(~F.startswith("name", F.lit("__"))).select("o", "p", F.lit(2).alias("q"), F.col("rank").alias("r"), F.concat(F.lit("        +"), "name", F.lit("() "), F.coalesce("rt", F.lit(""))).alias("line"))
    part = lambda q, line: shown.select("o", "p", F.lit(q).alias("q"), F.lit(0).alias("r"), line.alias("line"))
    base = F.trim(F.get(F.split(F.coalesce("extends", F.lit("")), ","), F.lit(0)))
    parents = shown.filter((base != "") & (base != "object")).select("o", "p", F.lit(4).alias("q"), F.lit(0).alias("r"), F.concat(F.lit("    "), base, F.lit(" <|-- "), "cls").alias("line"))
    rows = part(0, F.concat(F.lit("    class "), F.col("cls"), F.lit("{"))).unionByName(attributes).unionByName(methods).unionByName(part(3, F.lit("    }"))).unionByName(parents)
    return lines_to_text(rows, ["o", "p", "q", "r"], "classDiagram", "    class NoClasses{\n        No classes detected\n    }")


def folders(dirs: DataFrame, purposes: Column | None = None) -> DataFrame:
    """The two shallowest levels of directories, with short purposes."""
    nodes = folder_nodes(dirs).join(dirs.select("dir", "n_files"), "dir")
    from ..operators.facts import directory_purpose

    purpose = directory_purpose(F.col("dir"), F.col("n_files")) if purposes is None else purposes
    label = F.concat(paths.name_of(F.col("dir")), F.when((purpose != "") & (F.length(purpose) < 50), F.concat(F.lit("<br/><small>"), purpose, F.lit("</small>"))).otherwise(""))
    own = F.concat(F.lit("Dir"), F.col("node").cast("string"))
    above = F.when(F.col("parent_node").isNull(), "Root").otherwise(F.concat(F.lit("Dir"), F.col("parent_node").cast("string")))
    line = F.concat(F.lit("    "), own, F.lit('["'), label, F.lit('"]\n    '), above, F.lit(" --> "), own)
    return lines_to_text(nodes.select("node", line.alias("line")), ["node"], ["graph TD", '    Root["📁 Project Root"]'])


def data_flow(entry_points: DataFrame, packages: DataFrame) -> DataFrame:
    """Input, the first entry, processing, storage if a package is a database's, output."""
    first = entry_points.orderBy("file_ord", "label_ord").limit(1).agg(F.max(paths.name_of(F.col("path"))).alias("entry"))
    stored = packages.agg(F.coalesce(F.max(contains_any(F.lower("package"), tables.DATABASE_WORDS)), F.lit(False)).alias("db"))
    one = first.join(F.broadcast(stored))  # one row each
    storage = F.when(F.col("db"), F.lit('    Storage["💾 Data Storage<br/>(Database)"]\n    Process --> Storage\n    Storage --> Process\n')).otherwise("")
    return one.select(
        F.concat(
            F.lit('```mermaid\nflowchart LR\n    Input["📥 Input<br/>(User/API/File)"]\n    Entry["🚪 '), F.coalesce("entry", F.lit("Entry Point")),
            F.lit('"]\n    Input --> Entry\n    Process["⚙️ Processing<br/>(Business Logic)"]\n    Entry --> Process\n'), storage,
            F.lit('    Output["📤 Output<br/>(Response/File/Report)"]\n    Process --> Output\n```'),
        ).alias("content")
    )


def structure(files: DataFrame, project: str = "Project", max_dirs: int = 8, max_files: int = 10) -> DataFrame:
    """A subgraph for each top directory below the common prefix, the largest first, the rest as one."""
    prefix = paths.common_prefix(files)
    rel = files.join(F.broadcast(prefix)).withColumn("rel", paths.relative_segments(F.col("path"), F.col("prefix")))  # one row on the right
    rel = rel.withColumn("top", F.when(F.size("rel") > 1, F.get("rel", F.lit(0))).otherwise("(root)"))
    groups = top_and_other(rel.groupBy("top").agg(F.count(F.lit(1)).alias("n")), "top", "n", max_dirs)
    root = paths.safe_id(F.lit("ROOT"), F.lit(project))
    head = groups.select("rank", F.lit(0).alias("i"), F.concat(F.lit("  subgraph "), paths.safe_id(F.lit("SG"), F.col("top")), F.lit("["), escape_label(F.col("top")), F.lit("]")).alias("line"))
    tail = groups.select("rank", F.lit(1 << 30).alias("i"), F.lit("  end").alias("line"))
    one = lambda kind, i, label: F.concat(F.lit("    "), paths.safe_id(F.lit(kind), F.col("top"), *([i] if i is not None else [])), F.lit('["'), label, F.lit('"]\n    '), root, F.lit(" --> "), paths.safe_id(F.lit(kind), F.col("top"), *([i] if i is not None else [])))
    listed = first_per_group(rel.drop("rank"), ["top"], [F.col("file_ord")], max_files).withColumnRenamed("rank", "i").join(groups.filter("top <> '…other'"), "top")
    shown = listed.select("rank", "i", one("F", F.col("i").cast("string"), escape_label(paths.short_relative_label(F.col("rel")))).alias("line"))
    more = groups.filter((F.col("n") > max_files) & (F.col("top") != "…other")).select("rank", F.lit(max_files + 1).alias("i"), one("MORE", None, F.concat(F.lit("… +"), (F.col("n") - max_files).cast("string"), F.lit(" more"))).alias("line"))
    other = groups.filter("top = '…other'").select("rank", F.lit(1).alias("i"), one("F", F.lit("1"), F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" files"))).alias("line"))
    return lines_to_text(head.unionByName(shown).unionByName(more).unionByName(other).unionByName(tail), ["rank", "i"], ["flowchart TD", "  " + "ROOT_" + "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in project) + f"[{project}]"], "  A[No files]", fence=False)


def language_pie(files: DataFrame, column: str = "path", table=tables.DIAGRAM_LANGUAGES) -> DataFrame:
    counts = language_counts(files, column, table)
    line = F.concat(F.lit('  "'), escape_label(F.col("language")), F.lit('" : '), F.col("n_files").cast("string"))
    return lines_to_text(counts.select("first_ord", "language", line.alias("line")), ["first_ord", "language"], "pie title Language Mix", '  "Unknown" : 1', fence=False)


def top_classes(classes: DataFrame, most: int = 12) -> DataFrame:
    """The classes with the most methods and their files."""
    from pyspark.sql import Window

    first = largest(classes.filter("name <> ''"), "n_methods", "name", most)
    rows = first.withColumn("i", F.row_number().over(Window.orderBy(F.desc("n_methods"), "name", "path")))
    label = paths.short_path(F.col("path"))
    n = F.col("i").cast("string")
    own, file = paths.safe_id(F.lit("C"), F.col("name"), n), paths.safe_id(F.lit("CF"), label, n)
    line = F.concat(F.lit("    "), own, F.lit('["'), escape_label(F.col("name")), F.lit(" ("), F.col("n_methods").cast("string"), F.lit(')"]\n    '), file, F.lit('["'), escape_label(label), F.lit('"]\n    '), own, F.lit(" --> "), file)
    ends = rows.agg(F.count(F.lit(1)).alias("k")).filter("k > 0").select(F.lit(1 << 30).alias("i"), F.lit("  end").alias("line"))
    return lines_to_text(rows.select("i", line.alias("line")).unionByName(ends), ["i"], ["flowchart LR", "  subgraph TopClasses[Top Classes by Methods]"], "  end", fence=False)


SEQUENCE = "sequenceDiagram\n  autonumber\n  participant User\n  participant Scan\n  participant Parse\n  participant Facts\n  participant Provider\n  participant Out\n\n  User->>Scan: choose a folder\n  Scan->>Parse: files\n  Parse->>Facts: symbols, classes, imports\n  Facts->>Provider: snippets (optional)\n  Provider-->>Facts: details\n  Facts->>Out: README, diagrams\n"


def fenced(diagram: str) -> str:
    return f"```mermaid\n{diagram}\n```"
