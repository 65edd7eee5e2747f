"""A small source tree from scan to README."""

import pytest
from pyspark.sql import functions as F

from codelake.plans import diagrams, engine
from codelake.plans.markdown import Markdown, page, render_file, to_html
from codelake.sources.config import Config, least_timeout, merge, setup_logging
from codelake.sources.providers import NullProvider
from codelake.sources.tree import MOST, decoded, read_tree
from codelake.streaming.ingest import watch, windowed_counts

from .test_extract import JAVA, JS, PY, TS

MAIN = '''"""Entry of the tool."""
import argparse
from shop.core import run

def parse_args():
    """Parse the command line."""
    return argparse.ArgumentParser()

if __name__ == "__main__":
    run(parse_args())
'''
API = '''import flask
from .core import run

@app.route("/items")
def items(n=1):
    """List items."""
    return run(n)

@app.post("/items")
def add():
    return 1
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop-project")
    files = {
        "main.py": MAIN, "shop/__init__.py": "", "shop/_private.py": "def hidden():\n    pass\n", "shop/__main__.py": "x = 1\n", "shop/core.py": PY, "shop/api/api_server.py": API,
        "shop/services/box.js": JS, "shop/services/calc.ts": TS, "shop/models/Calc.java": JAVA, "tests/test_core.py": "import pytest\n\ndef test_x():\n    assert 1\n",
        ".git/x.py": "x", "node_modules/x.js": "x", "a.spec.ts": "x", "latest.js": "x", "x.d.ts": "x", "y.jsx": "x", "bad.py": "def f(:", "config.yaml": "a: 1\n" * 400, "Dockerfile": "FROM x",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content, encoding="utf-8")
    (root / "latin.py").write_bytes("# é\nY = 1\n".encode("latin-1"))
    (root / "huge.py").write_bytes(b"#" * (MOST + 1))
    return str(root)


@pytest.fixture(scope="module")
def project(spark, tree):
    return engine.build(spark, tree, "Shop Project")


def names(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_scan(project):
    found = {r["path"] for r in project.files.collect()}
    assert found == {"main.py", "shop/__init__.py", "shop/_private.py", "shop/__main__.py", "shop/core.py", "shop/api/api_server.py", "shop/services/box.js", "shop/services/calc.ts", "shop/models/Calc.java", "tests/test_core.py", "bad.py", "latin.py"}
    assert "é" in project.files.filter("path = 'latin.py'").first()["content"]
    assert names(project.diagnostics, "path", "stage") == [("bad.py", "parse")]


def test_scan_options(spark, tree):
    assert {r["path"].rpartition("/")[2] for r in read_tree(spark, tree, prune="shop,tests,node_modules,.git", leaveout="bad").collect()} >= {"main.py", "latest.js"}
    assert read_tree(spark, tree, maxbytes="30", chunkbytes="10").filter("length > 30").count() == 0


def test_binary_files(spark, tree):
    rows = decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tree))
    got = {r["path"].rpartition("/")[2]: r["content"] for r in rows.collect()}
    assert "é" in got["latin.py"] and "huge.py" not in got and "__init__.py" not in got


def test_facts(project):
    assert ("main.py", "main") in names(project.entry_points, "path", "type") and ("shop/api/api_server.py", "api") in names(project.entry_points, "path", "type")
    assert project.architecture.first()["primary_pattern"] == "MVC"
    dirs = {r["dir"]: r["n_files"] for r in project.directories.collect()}
    assert dirs["shop"] == 8
    assert names(project.languages, "language") == [("Java",), ("JavaScript",), ("Python",), ("TypeScript",)]
    kinds = dict(names(project.classified_imports, "module", "kind"))
    assert kinds["shop.core"] == "internal" and kinds["core"] == "internal" and kinds["flask"] == "external" and kinds["argparse"] == "stdlib"
    assert names(project.frameworks, "name") == [("flask",)] and project.testing.first()["frameworks"] == ["pytest"]
    assert names(project.config_files, "file") == [("Dockerfile",), ("config.yaml",)]
    example = project.config_examples.first()
    assert example["code"].endswith("# ... (truncated)") and example["language"] == "yaml" and len(example["code"]) == 1000 + len("\n# ... (truncated)")
    stats = project.statistics.first()
    assert stats["total_files"] == 11 and stats["total_classes"] == 6
    assert project.complexity.first()["max_complexity"] == 4


def test_examples(project):
    usage = [(r["title"], r["code"]) for r in project.examples_usage.collect()]
    assert usage == [("Basic Usage", "run(parse_args())")]
    api = project.examples_api.collect()
    assert [r["title"] for r in api] == ["API Endpoint: items", "API Endpoint: add"] and api[0]["code"].startswith("@app.route('/items')\ndef items(n=1):")
    assert [r["title"] for r in project.examples_cli.collect()] == ["CLI: parse_args"]
    assert project.examples_import.first()["code"].startswith("from ")


def test_sql(spark, project):
    project.register("shop_")
    assert spark.sql("select count(*) as n from shop_symbols s join shop_classes c on s.path = c.path and s.class_name = c.name").first()["n"] > 5


def test_diagrams(project):
    made = {r["name"]: r["content"] for r in engine.artifacts(project).collect()}
    assert set(made) == {"architecture", "dependencies", "classes", "folder_structure", "data_flow", "structure", "languages", "top_classes"}
    assert made["architecture"].startswith("```mermaid\ngraph TD\n    Entry0[") and "Entry0 --> Controller" in made["architecture"]
    assert 'api_server["api_server"]' in made["dependencies"] and "api_server --> core" in made["dependencies"]
    assert "    class Box{\n        +int size\n        +_hid() \n        +open() \n    }\n    Base <|-- Box" in made["classes"]
    assert "Root --> Dir1" in made["folder_structure"] and 'Entry["🚪 main.py"]' in made["data_flow"]
    assert made["structure"].startswith("flowchart TD\n  ROOT_Shop_Project[Shop Project]\n  subgraph SG_shop[shop]") and made["languages"].startswith('pie title Language Mix\n  "Python" : ')
    assert 'C_Calc_1["Calc (4)"]' in made["top_classes"]


def test_empty_diagrams(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert "NoDepends" in diagrams.dependencies(none("src string, dst string")).first()["content"]
    assert diagrams.language_pie(none("path string, file_ord int")).first()["content"] == 'pie title Language Mix\n  "Unknown" : 1'
    assert "Entry0" not in diagrams.architecture(none("path string, file_ord int, label_ord int, type string"), spark.createDataFrame([("MVC",)], "primary_pattern string"), none("dir string")).first()["content"]
    assert diagrams.fenced("x") == "```mermaid\nx\n```" and diagrams.SEQUENCE.startswith("sequenceDiagram")


def test_many_directories(spark):
    files = spark.createDataFrame([(f"r/d{i}/f{k}.py", 100 * i + k) for i in range(10) for k in range(12 - i)], "path string, file_ord int")
    text = diagrams.structure(files, "P", 8, 10).first()["content"]
    assert text.count("subgraph") == 8 and "… +2 more" in text and "... 12 files" in text


def test_readme(spark, project, tmp_path):
    row = engine.readme(project, NullProvider(), F.lit("2020-01-01 00:00:00").cast("timestamp")).first()
    assert row["text"].startswith("# Shop Project") and "graph TD" in row["text"] and "[Architecture Diagram]" not in row["text"] and row["issues"] == []
    path = engine.save_readme(project, str(tmp_path))
    assert path.endswith("Shop_Project/README.md")
    prompt = engine.readme_prompt(project)
    facts = {(r["path"], r["kind"]): r["fact"] for r in engine.file_outline(project, 12, 9).collect()}
    assert "`Box` from Base" in facts["shop/core.py", "class"] and facts["shop/core.py", "field"] == "`Box.size`"
    assert "`Box.open()`" in prompt and "`fetch(u, *, n=1)` gives Coroutine[str]" in prompt and "`flask` (external)" in prompt
    assert "11 files" in prompt and "`shop/api/api_server.py`" in prompt and "- tests: " in prompt
    small = engine.file_outline(project, 2, 1)
    assert small.groupBy("path", "kind").count().filter("count > 1").count() == 0 and small.select("path").distinct().count() == 2

    class Fixed:
        def generate(self, system, prompt, temperature=0.2):
            return "# T\n## Architecture\nyour-repo line\nhttp://h:80items\n## Architecture\nagain"

    made = engine.readme(project, Fixed()).first()["text"]
    assert "your-repo" not in made and "http://h:80/items" in made and "again" not in made and made.count("graph TD") == 1


def test_markdown(tmp_path):
    m = Markdown().add_heading("T", 9).add_paragraph("p **b** `c<d`").add_list_item("x", 1).add_ordered_item("y", 2).add_code_block("a<b", "py").add_quote("q").add_horizontal_rule()
    m.add_table_header(["a", "b"], ["left", "right"]).add_table_row(["1", "2|3"]).add_link("t", "u", "v").add_image("i", "j").add_blank_line().add_line("end")
    text = m.build()
    assert text.startswith("###### T\n") and "| :--- | ---: |" in text and '[t](u "v")' in text and "![i](j)" in text
    made = to_html(text + "\n\n```mermaid\ngraph TD\n```")
    for part in ("<h6>T</h6>", "<strong>b</strong>", "<code>c&lt;d</code>", '<pre><code class="language-py">a&lt;b</code></pre>', "<blockquote>q</blockquote>", "<hr>", "<th>a</th>", '<div class="mermaid">\ngraph TD\n</div>', '<a href="u" title="v">t</a>', '<img src="j" alt="i">'):
        assert part in made
    assert m.clear().build() == "" and Markdown.italic("x") == "*x*"
    (tmp_path / "a.md").write_text("# Hi", encoding="utf-8")
    render_file(str(tmp_path / "a.md"), str(tmp_path / "o" / "a.html"), title="X")
    assert "<h1>Hi</h1>" in (tmp_path / "o" / "a.html").read_text(encoding="utf-8") and "<title>A</title>" in page("x", "A")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("llm:\n  temperature: 1\nreadme: {x: 1}\n", encoding="utf-8")
    c = Config(str(tmp_path / "c.yaml"))
    assert c.get("llm.temperature") == 1 and c.get("llm.timeout") == 120 and c.get("no.such", 7) == 7 and not c.unknown
    for bad in ({"llm": {"temperature": 3}}, {"logging": {"level": "LOUD"}}, {"parallel": {"max_workers": 0}}, {"cache": {"file": " "}}, {"rate_limiting": {"calls_per_minute": "x"}}):
        with pytest.raises(ValueError):
            Config(over=bad)
    env = Config().with_environment(env={"CODELAKE_MODEL": "big:14b", "CODELAKE_TIMEOUT": "60"})
    assert env.get("llm.model") == "big:14b" and env.get("llm.timeout") == 300 and least_timeout("x:30b") == 480 and least_timeout("x:7b") == 0
    log = setup_logging(Config(over={"logging": {"file": str(tmp_path / "run.log"), "level": "debug"}}))
    log.debug("hello")
    assert "hello" in (tmp_path / "run.log").read_text(encoding="utf-8")
    base = {"a": {"b": 1}}
    assert merge(base, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}} and base == {"a": {"b": 1}}


def test_streaming(spark, tree, tmp_path):
    out = str(tmp_path / "facts")
    for _ in range(2):  # the second run finds nothing new
        watch(spark, tree, out, str(tmp_path / "check"), "*.py").awaitTermination()
    rows = spark.read.parquet(f"{out}/symbols").filter("name = 'fetch'")
    assert rows.count() == 1 and spark.read.parquet(f"{out}/diagnostics").count() == 1
    events = spark.createDataFrame([("2020-01-01 00:01:00", "a"), ("2020-01-01 00:04:00", "a"), ("2020-01-01 00:06:00", "b")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted((r["k"], r["n"]) for r in windowed_counts(events, "t", "k").collect()) == [("a", 2), ("b", 1)]


def test_empty_project(spark, tmp_path):
    p = engine.build(spark, str(tmp_path), "Nothing")
    assert p.files.count() == 0 and engine.readme(p).first()["text"].startswith("# Project README")
    assert p.statistics.first()["total_files"] == 0 and engine.artifacts(p).count() == 8
