"""From a source tree to fact tables and a README."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import safe_output_name
from ..operators import examples, extraction, facts, graph, metrics, rank, rewrite
from ..sources.providers import NullProvider, Provider
from ..sources.tree import config_examples, config_files, read_tree
from . import diagrams, outline
from .markdown import Markdown, write


@dataclass
class Project:
    """Fact tables of a project, by name; also registered as temporary views for SQL."""

    spark: SparkSession
    root: str
    name: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def register(self, prefix: str = "") -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)


def build(spark: SparkSession, root: str, name: str | None = None, files: DataFrame | None = None, **options) -> Project:
    """Scan and parse a folder. The parsed rows are written once to the shared folder, as all tables read them.

    ``files``: the rows of ``sources.scan.scan(spark, root)``, for a root on any file system (configuration
    files are looked up in local roots only); by default the local folder is read with ``options``."""
    files = read_tree(spark, root, **options) if files is None else files.withColumn("file_ord", F.col("file_ord").cast("int"))
    files = files.withColumn("path", paths.relative(F.col("path"), root))
    parsed = graph._cut(extraction.parse_files(files))
    out = Project(spark, root, name or root.rstrip("/").rpartition("/")[2])
    t = out.tables
    t["files"], t["parsed"] = files, parsed
    t["summaries"], t["symbols"], t["classes"] = extraction.summaries(parsed), extraction.symbols(parsed), extraction.classes(parsed)
    t["imports"], t["variables"], t["diagnostics"] = extraction.imports(parsed), extraction.variables(parsed), extraction.diagnostics(parsed)
    t["parameters"] = extraction.parameters(t["symbols"])
    t["classified_imports"] = facts.classified_imports(t["imports"], t["summaries"])
    t["entry_points"] = facts.entry_points(t["summaries"])
    t["directories"] = facts.directory_rollup(t["summaries"])
    t["architecture"] = facts.architecture(t["summaries"])
    t["module_tree"] = facts.module_tree(t["summaries"])
    spans = t["symbols"].filter("class_name is null").select("lines.start", "lines.end").unionByName(t["classes"].select("lines.start", "lines.end"))
    t["statistics"] = facts.file_statistics(t["summaries"], spans)
    t["complexity"] = facts.complexity_overview(t["symbols"].filter("class_name is null").select(F.col("complexity.cyclomatic").alias("cyclomatic")))
    t["dependencies"] = facts.dependency_summary(t["classified_imports"])
    t["features"] = facts.keyword_features(t["symbols"].filter("class_name is null").select("name").unionByName(t["classes"].select("name")))
    t["frameworks"], t["languages"] = facts.frameworks(t["imports"]), facts.project_languages(t["summaries"])
    t["testing"] = facts.testing_summary(t["summaries"], t["imports"])
    t["config_files"], t["config_examples"] = config_files(spark, root), config_examples(spark, root)
    t["important"] = rank.top_files(t["summaries"], 12)
    t["module_edges"] = module_edges(t["classified_imports"], t["summaries"])
    t["graph_symbols"] = graph_symbols(t["symbols"], t["classes"])
    t["language_counts"] = metrics.language_counts(t["summaries"])
    t["examples_usage"], t["examples_api"] = examples.usage(files, t["symbols"]), examples.api(t["symbols"])
    t["examples_cli"] = examples.cli(t["summaries"], t["symbols"], t["imports"])
    t["examples_import"] = examples.import_lines(t["summaries"], t["symbols"], t["classes"])
    return out


def module_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst by module name, for internal imports."""
    source = F.regexp_replace(paths.name_of(F.col("path")), r"\.\w+$", "")
    target = F.element_at(F.split(F.when(F.col("module") == "", F.col("name")).otherwise(F.col("module")), r"[./]"), -1)
    return imports.filter("kind = 'internal'").select(source.alias("src"), target.alias("dst")).filter("src <> dst and dst <> ''").distinct()


def graph_symbols(symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """The symbol rows of ``operators.metrics``."""
    none = F.array().cast("array<string>")
    of_symbols = symbols.select("name", F.col("kind").alias("type"), F.col("path").alias("file_path"), F.col("lines.start").alias("line"), F.col("class_name").alias("parent"), F.coalesce("exported", F.lit(False)).alias("is_exported"), F.coalesce("async", F.lit(False)).alias("is_async"), "decorators", F.col("function_calls").alias("calls"), F.col("function_calls").alias("references"))
    of_classes = classes.select("name", F.lit("class").alias("type"), F.col("path").alias("file_path"), F.col("lines.start").alias("line"), F.lit(None).cast("string").alias("parent"), F.coalesce("exported", F.lit(False)).alias("is_exported"), F.lit(False).alias("is_async"), "decorators", none.alias("calls"), F.when(F.col("extends") != "", F.split("extends", r",\s*")).otherwise(none).alias("references"))
    return of_symbols.unionByName(of_classes)


def all_diagrams(p: Project) -> dict[str, DataFrame]:
    """One-row DataFrames with ``content``, by name."""
    external = p.classified_imports.filter("kind = 'external'").select("package")
    return {
        "architecture": diagrams.architecture(p.entry_points, p.architecture, p.directories),
        "dependencies": diagrams.dependencies(p.module_edges),
        "classes": diagrams.class_diagram(p.classes, p.symbols, p.variables),
        "folder_structure": diagrams.folders(p.directories),
        "data_flow": diagrams.data_flow(p.entry_points, external),
        "structure": diagrams.structure(p.summaries, p.name),
        "languages": diagrams.language_pie(p.summaries),
        "top_classes": diagrams.top_classes(p.classes),
    }


def artifacts(p: Project) -> DataFrame:
    """name, content of all diagrams."""
    out = None
    for name, df in all_diagrams(p).items():
        row = df.select(F.lit(name).alias("name"), "content")
        out = row if out is None else out.unionByName(row)
    return out


def file_outline(p: Project, files: int = 10, facts: int = 8) -> DataFrame:
    """The facts of the most important files, a row each."""
    return outline.outline(p.summaries, p.classes, p.symbols, p.variables, p.classified_imports, files, facts)


def overview(p: Project, limit: int = 20) -> DataFrame:
    """topic, ord, fact: what is known of the project as a whole, ``limit`` rows a topic at most."""
    said = lambda topic, df, order, fact: df.orderBy(*order).limit(limit).select(F.lit(topic).alias("topic"), F.monotonically_increasing_id().alias("ord"), fact.alias("fact"))
    stats, arch, tests = p.statistics, p.architecture, p.testing
    counts = F.format_string("%s files, %s functions, %s classes, about %s lines", *(F.col(c).cast("string") for c in ("total_files", "total_functions", "total_classes", "estimated_lines")))
    one = [F.lit(1)]
    rows = [
        said("pattern", arch, one, F.concat("primary_pattern", F.lit(": "), "description")),
        said("size", stats, one, counts),
        said("language", p.languages, ["language"], F.col("language")),
        said("framework", p.frameworks, ["name"], F.col("name")),
        said("feature", p.features, ["ord"], F.col("feature")),
        said("entry point", p.entry_points, ["file_ord", "label_ord"], F.concat("description", F.lit(": `"), "path", F.lit("`"))),
        said("package", p.dependencies.select(F.explode("external_packages").alias("name")), ["name"], F.col("name")),
        said("setting", p.config_files, ["ord"], F.concat(F.lit("`"), "file", F.lit("`: "), "description")),
        said("tests", tests, one, F.concat(F.col("test_count").cast("string"), F.lit(" files; "), F.array_join("frameworks", ", "))),
    ]
    return reduce(DataFrame.unionByName, rows)


def readme_prompt(p: Project) -> str:
    """What a provider is told about the project: a bounded number of facts."""
    known: dict[str, list[str]] = {}
    for r in overview(p).orderBy("topic", "ord").collect():
        known.setdefault(r["topic"], []).append(r["fact"])
    m = Markdown().add_lines(f"Write the README of the project {p.name}. Use only what is listed here; name no file or function that is not.", "")
    m.add_heading("Project", 2).add_lines(*(f"- {topic}: {'; '.join(facts)}" for topic, facts in known.items()))
    m.add_heading("Files", 2).add_lines(outline.text(file_outline(p)).first()["content"], "")
    m.add_heading("Form", 2).add_lines("Say what the project does, how it is built, how to start and how to use it. Put the line [Architecture Diagram] and the line [Folder Structure] where these belong.")
    return m.build()


#: When not even the facts can be read.
FALLBACK = "# Project README\n\n## Overview\n\nGenerated automatically.\n\n## License\n\nSee the LICENSE file.\n"


def template(p: Project) -> str:
    """A README from the facts alone, for runs without a provider."""
    arch, stats = p.architecture.first(), p.statistics.first()
    m = Markdown().add_heading(p.name).add_paragraph(f"{stats['total_files']} files, {stats['total_functions']} functions, {stats['total_classes']} classes.")
    m.add_heading("Architecture", 2).add_paragraph(f"{arch['primary_pattern']}: {arch['description']}").add_paragraph("[Architecture Diagram]")
    m.add_heading("Project Structure", 2).add_paragraph("[Folder Structure]")
    m.add_heading("Dependencies", 2).add_paragraph("[Dependency Diagram]").add_heading("Data Flow", 2).add_paragraph("[Data Flow]")
    m.add_heading("Key Components", 2).add_paragraph(outline.text(file_outline(p), "####").first()["content"])
    shown = [e for t in ("usage", "api", "cli", "import") for e in p.tables[f"examples_{t}"].collect()]  # a few rows each
    if shown:
        m.add_heading("Examples", 2)
        for e in shown:
            m.add_paragraph(Markdown.bold(e["title"])).add_code_block(e["code"], e["language"])
    return m.build()


def readme(p: Project, provider: Provider | None = None, stamp=None) -> DataFrame:
    """One row: text, issues. The provider's text if it gives any, else the template, spliced with
    diagrams and post-processed."""
    text = ""
    if provider is not None and not isinstance(provider, NullProvider):
        try:
            text = provider.generate("You write READMEs.", readme_prompt(p), 0.2)
        except Exception:
            text = ""
    if not text:
        text = template(p) if p.summaries.take(1) else FALLBACK
    made = p.spark.createDataFrame([(p.name, text)], "name string, text string")
    drawn = all_diagrams(p)
    for key in rewrite.DIAGRAM_MARKS:
        made = made.join(F.broadcast(drawn[key].withColumnRenamed("content", f"d_{key}")))  # one row each
    return rewrite.post_process(made, "name", "text", {k: F.col(f"d_{k}") for k in rewrite.DIAGRAM_MARKS}, stamp)


def save_readme(p: Project, folder: str, **options) -> str:
    """Write the README below ``folder`` in a folder with the project's safe name."""
    safe = p.spark.createDataFrame([(p.name,)], "n string").select(safe_output_name(F.col("n")).alias("n")).first()["n"]
    return write(f"{folder}/{safe}/README.md", readme(p, **options).first()["text"])
