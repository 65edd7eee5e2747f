import pytest
from pyspark.sql import functions as F

from codelake.functions import tables
from codelake.operators import documents, examples, facts, graph, joins, metrics, rank, rewrite, schema
from codelake.sources.cache import DocCache
from codelake.sources.providers import HashProvider, HttpProvider, Limiter, NullProvider, embed

EDGES = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "B")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(x,) for x in "ABCDE"], "id string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_graph(spark, edges, nodes):
    reach = {}
    for s, d in rows(graph.closure(edges)):
        reach.setdefault(s, set()).add(d)
    assert reach == {"A": {"B", "C"}, "B": {"A", "C"}, "C": {"A", "B"}, "D": {"A", "B", "C"}}
    only = graph.closure(edges, spark.createDataFrame([("D",)], "id string"))
    assert rows(only) == [("D", "A"), ("D", "B"), ("D", "C")]
    assert rows(graph.entry_nodes(edges, nodes)) == [("E",)] and rows(graph.leaf_nodes(edges, nodes)) == [("D",), ("E",)]
    assert rows(graph.cycles(edges)) == [(["A", "B", "C", "A"],)] and rows(graph.cycle_members(edges)) == [("A",), ("B",), ("C",)]
    assert rows(graph.dependencies(edges, "A")) == [("B",)] and rows(graph.dependents(edges, "B")) == [("A",), ("D",)]
    loop = spark.createDataFrame([("x", "x"), ("x", "y")], "src string, dst string")
    assert rows(graph.cycles(loop)) == [(["x", "x"],)] and rows(graph.closure(loop)) == [("x", "y")]


def test_all_cycles(spark):
    """No cycle is too long: a ring of nine nodes, and all 89 cycles of five nodes that all meet."""
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)], "src string, dst string")
    assert rows(graph.cycles(ring)) == [([*(f"n{i}" for i in range(9)), "n0"],)]
    full = spark.createDataFrame([(a, b) for a in "abcde" for b in "abcde"], "src string, dst string")
    assert graph.cycles(full).count() == 89 and graph.cycles(full, 4).count() == 65


def test_levels_and_chains(spark):
    dag = spark.createDataFrame([("p", "q"), ("q", "r"), ("p", "r")], "src string, dst string")
    assert rows(graph.topological_levels(dag)) == [("p", 2), ("q", 1), ("r", 0)]
    calls = spark.createDataFrame([("f", "g"), ("g", "h"), ("f", "f")], "src string, dst string")
    assert rows(graph.call_chains(calls, "f")) == [(["f", "g", "h"],)] and rows(graph.call_chains(calls)) == [(["f", "g", "h"],)]
    long = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)], "src string, dst string")
    assert rows(graph.call_chains(long, "n00")) == [] and rows(graph.call_chains(long, "n05"))[0][0][-1] == "n12"


def test_export(spark, edges, nodes):
    got = {r["id"]: r for r in graph.export(edges, nodes).collect()}
    assert got["B"]["dependents"] == ["A", "D"] and got["E"]["dependencies"] == []
    assert got["A"]["json"] == '{"id":"A","dependencies":["B"],"dependents":["C"]}'


def test_coupling(spark, edges, nodes):
    got = {r["id"]: (r["efferent"], r["afferent"], r["instability"]) for r in metrics.coupling(edges, nodes).collect()}
    assert got == {"A": (1, 1, 0.5), "B": (1, 2, pytest.approx(1 / 3)), "C": (1, 1, 0.5), "D": (1, 0, 1.0), "E": (0, 0, 0.0)}


def test_existing_edges(spark, edges):
    some = spark.createDataFrame([("A",), ("B",)], "id string")
    assert rows(joins.existing_edges(edges, some)) == [("A", "B")]


def test_cohesion_and_buckets(spark):
    s = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c")], "module string, name string")
    r = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "z"), ("o", "q")], "module string, ref string")
    assert {x["module"]: round(x["cohesion"], 3) for x in metrics.cohesion(s, r).collect()} == {"m": 0.667, "n": 1.0, "o": 0.0}
    n = spark.createDataFrame([(3,), (4,), (7,), (8,), (15,), (16,)], "n_calls int")
    assert tuple(metrics.call_buckets(n).first()) == (1, 2, 2, 1)


def test_symbol_metrics(spark):
    cols = "name string, type string, file_path string, parent string, is_exported boolean, is_async boolean, decorators array<string>, calls array<string>, references array<string>"
    s = spark.createDataFrame(
        [
            ("load", "function", "a.py", None, True, False, [], ["open", "db.query"], ["x"]),
            ("save", "function", "a.py", None, False, True, ["deco"], ["db.insert", "logger.error"], ["x"]),
            ("Box", "class", "b.py", None, True, False, [], [], []),
            ("get_instance", "method", "b.py", "Box", False, False, [], ["raise_error"], []),
            ("make_box", "function", "b.py", None, False, False, [], [], []),
            ("v", "variable", "b.py", None, False, False, [], [], ["load", "save"]),
        ],
        cols,
    )
    assert rows(metrics.data_sources(s)) == [("a.py", "load")] and rows(metrics.data_sinks(s)) == [("a.py", "save")]
    assert rows(metrics.error_handling(s)) == [("get_instance", ["raise_error"]), ("save", ["logger.error"])]
    assert rows(metrics.async_patterns(s)) == [("save", ["async_function"])]
    assert dict(rows(metrics.design_patterns(s))) == {"singleton": "Box", "factory": "make_box", "decorator": "save"}
    assert rows(metrics.cross_references(s))[-2:] == [("x", "a.py:load"), ("x", "a.py:save")]
    assert rows(metrics.variable_flow(s)) == [("v", ["load", "save"])] and metrics.api_boundary(s).count() == 2


def test_parameter_merge(spark):
    cols = "key int, name string, type string, default string, description string, optional boolean"
    ast = spark.createDataFrame([(1, "a", "int", "1", "", False), (1, "b", "", None, "", False)], cols)
    doc = spark.createDataFrame([(1, "a", "str", "9", "old", False, 0), (1, "a", "", None, "the a", True, 1), (1, " ", "x", "x", "x", False, 2)], cols + ", ord int")
    got = {r["name"]: r for r in joins.merge_declared(ast, doc, ["key"]).collect()}
    assert got["a"]["default"] == "1" and got["a"]["type"] == "int" and got["a"]["optional"] and got["a"]["description"] == "the a"
    compat = {r["name"]: r for r in joins.merge_declared(ast, doc, ["key"], default_type="any", compat=True).collect()}
    assert compat["a"]["default"] is None and compat["b"]["type"] == "any"
    assert joins.keep_last_rows(doc, ["key", "name"], ["ord"]).count() == 2


def test_cycle_members_of_random_graphs(spark):
    import random

    rng = random.Random(7)
    for n, m in ((12, 14), (30, 40), (8, 30)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        got = [r["id"] for r in graph.cycle_members(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()]
        assert sorted(got) == sorted(a for a, b in reach if a == b)


def test_one_long_schedule(spark):
    """All rows as one sequence, over several ranges, against the definition."""
    import random

    rng = random.Random(4)
    at = sorted(rng.randrange(0, 40_000_000_000) for _ in range(500))
    rows_ = [(i, t) for i, t in enumerate(at)]
    rng.shuffle(rows_)
    got = {r["i"]: r["start"] for r in rank.schedule(spark.createDataFrame(rows_, "i int, t long"), "t", 120_000_000, None, ["t", "i"]).collect()}
    last = None
    for i, t in enumerate(at):
        last = t if last is None else max(t, last + 120_000_000)
        assert got[i] == last


def test_rate_schedule(spark):
    at = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (20.0,)], "t double")
    assert [r["start"] for r in rank.schedule(at, "t", 5.0).orderBy("t").collect()] == [0, 5, 10, 20]
    times, slept = iter([0.0, 1.0, 2.0, 20.0]), []
    limit = Limiter(12, clock=lambda: next(times), sleep=slept.append)
    assert [limit.wait() for _ in range(4)] == [0, 5, 10, 20] and slept == [4, 8] and limit.stats()["calls"] == 4


def test_section_dedup(spark):
    docs = spark.createDataFrame([(1, "## A\nx\n## B\ny\n## A\nz\n## C\nw")], "doc_id int, text string")
    assert rewrite.dedup_sections(docs).first()["text"] == "## A\nx\n## B\ny\n## C\nw"


def test_rollup_and_purpose(spark):
    files = spark.createDataFrame([("src/a/x", 0), ("src/a/y", 1), ("src/z", 2)], "path string, file_ord int")
    assert rows(facts.directory_rollup(files)) == [("src", 1, "", 3, 0), ("src/a", 2, "src", 2, 0)]
    of = lambda d: spark.createDataFrame([(d,)], "d string").select(facts.directory_purpose(F.col("d"), F.lit(3)).alias("p")).first()["p"]
    assert of("my_Tests") == "Unit tests and test suites" and of("zzz") == "Contains 3 file(s)"
    tree = facts.nested_tree([{"dir": "a/b", "name": "c.py", "n_functions": 1, "n_classes": 2, "n_imports": 3}])
    assert tree == {"a": {"b": {"c.py": {"functions": 1, "classes": 2, "imports": 3}}}}


@pytest.mark.parametrize("values,want", [([4, 5.98], "Low"), ([5], "Moderate"), ([10], "High"), ([0], "Unknown")])
def test_complexity_levels(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "cyclomatic double")
    assert facts.complexity_overview(df).first()["level"] == want


def test_classifiers(spark):
    files = spark.createDataFrame([("p/main.py", 0, ""), ("p/api_server.py", 1, ""), ("p/x.py", 2, 'if __name__ == "__main__": pass'), ("p/cli.py", 3, 'if __name__ == "__main__"')], "path string, file_ord int, summary string")
    got = [(r["path"], r["type"]) for r in facts.entry_points(files).orderBy("file_ord", "label_ord").collect()]
    assert got == [("p/main.py", "main"), ("p/api_server.py", "api"), ("p/x.py", "executable"), ("p/cli.py", "cli")]
    mvc = spark.createDataFrame([("app/models/a.py",), ("app/views/b.py",), ("app/services/c.py",), ("lib/d/e/f.py",)], "path string")
    row = facts.architecture(mvc).first()
    assert row["primary_pattern"] == "MVC" and row["patterns"] == ["MVC", "Layered"] or set(row["patterns"]) == {"MVC", "Layered"}
    flat = facts.architecture(spark.createDataFrame([("a.py",)], "path string")).first()
    assert flat["primary_pattern"] == "Simple/Flat"
    names = spark.createDataFrame([("user_auth",), ("train_model",)], "name string")
    assert [r["feature"] for r in facts.keyword_features(names).orderBy("ord").collect()] == ["Database", "Authentication", "Machine Learning"]
    imp = spark.createDataFrame([("t/test_a.py", "pytest", None, None, 0, 1), ("a.py", "os.path", None, None, 0, 1), ("a.py", "x", "y", None, 1, 2), ("a.py", "pkg.core", "run", None, 0, 3), ("a.py", "flask", None, None, 0, 4)], "path string, module string, name string, alias string, level int, line int")
    mods = spark.createDataFrame([("pkg/core.py",)], "path string")
    kinds = {r["module"]: r["kind"] for r in facts.classified_imports(imp, mods).collect()}
    assert kinds == {"pytest": "external", "os.path": "stdlib", "x": "internal", "pkg.core": "internal", "flask": "external"}
    assert {r["module"]: r["kind"] for r in facts.classified_imports(imp, compat=True).collect()}["x"] == "external"
    summary = facts.dependency_summary(facts.classified_imports(imp, mods)).first()
    assert summary["external_packages"] == ["flask", "pytest"] and summary["n_internal"] == 2 and summary["most_used"] == "flask"
    assert [r["name"] for r in facts.frameworks(imp).collect()] == ["flask"]
    t = facts.testing_summary(spark.createDataFrame([("t/test_a.py",), ("a.py",)], "path string"), imp).first()
    assert (t["test_count"], t["frameworks"], t["ratio"]) == (1, ["pytest"], "1/2 files")
    assert len(tables.STDLIB) == len(set(tables.STDLIB)) and len(tables.PURPOSES) == 35


def test_rewrites(spark):
    of = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]
    assert of("http://h:3000items", rewrite.fix_port) == "http://h:3000/items"
    assert of("http://example.com", rewrite.split_host) == "http://example.co/m"
    assert of("srcindex.js application", rewrite.fix_separators) == "src/index.js application"
    assert of("application", lambda c: rewrite.fix_separators(c, compat=True)) == "app/lication"
    assert of("a\nyour-repo here\nb", rewrite.drop_lines) == "a\nb"
    assert of('see "C:\\a\\b.txt" x', rewrite.drop_windows_paths) == 'see "" x'
    assert of("[My Diagram] [some PLACEHOLDER here] [ok]", rewrite.drop_marks) == "  [ok]"
    spliced = of("## Architecture\ntext", lambda c: rewrite.splice_diagrams(c, {"architecture": F.lit("D")}))
    assert spliced == "## Architecture\n\nD\n\ntext"
    assert of("x [Data Flow] y", lambda c: rewrite.splice_diagrams(c, {"data_flow": F.lit("D")})) == "x \nD\n y"
    found = of("C:\\x http://h:1a yourusername srcmain curl `GET items`", rewrite.issues)
    assert len(found) == 5 and found[0] == "Contains 1 absolute Windows paths"
    stamped = spark.createDataFrame([(1, "## A\n## A\n")], "doc_id int, text string")
    out = rewrite.post_process(stamped, stamp=F.lit("2020-01-02 03:04:05").cast("timestamp")).first()
    assert out["text"].endswith("*This README was automatically generated on 2020-01-02 03:04:05*\n") and out["text"].count("## A") == 1


def test_schema(spark):
    of = lambda j: spark.createDataFrame([(j,)], "j string").select(schema.errors(F.col("j")).alias("e"), schema.normalize(schema.parse(F.col("j"))).alias("n"), schema.warnings(schema.parse(F.col("j"))).alias("w")).first()
    good = of('{"project_name": "p", "files": [{"path": "a", "functions": [{"name": "f", "parameters": [{"type": "int"}]}], "classes": [{"methods": [{}]}]}]}')
    assert good["e"] == [] and good["w"] == ["f", "unnamed"]
    f = good["n"]["files"][0]["functions"][0]
    assert f["description"] == schema.DESCRIPTION and f["parameters"][0]["description"] == schema.PARAM_DESCRIPTION and f["returns"]["type"] == "void"
    assert good["n"]["files"][0]["classes"][0]["name"] == "UnnamedClass" and good["n"]["files"][0]["classes"][0]["methods"][0]["name"] == "unnamed"
    assert of('{"files": []}')["e"] == ["project_name is missing"] and of('{"project_name": "p"}')["e"] == ["files is missing"]
    assert of('{"project_name": "p", "files": [{}]}')["e"] == ["a file has no path"] and "not JSON" in of("{")["e"]
    assert of("{}")["n"]["project_name"] == "Unnamed Project" and of("{}")["n"]["files"] == []


def test_missing_keys(spark):
    of = lambda j: spark.createDataFrame([(j,)], "j string").select(schema.missing_keys(F.col("j"), ["a", "b", "c"]).alias("m")).first()["m"]
    assert of('{"b": 1}') == ["a", "c"] and of("[]") == ["a", "b", "c"] and of(None) == ["a", "b", "c"]


def test_ranks(spark):
    files = spark.createDataFrame([("a/main.py", 0, 0, 0), ("tests/x.py", 9, 9, 1), ("a/util.py", 1, 1, 2), ("api/r.py", 0, 5, 3)], "path string, n_classes int, n_functions int, file_ord int")
    assert [(r["path"], r["score"]) for r in rank.top_files(files, 3).collect()] == [("api/r.py", 55), ("a/main.py", 50), ("tests/x.py", 35)]
    g = spark.createDataFrame([(f"g{i}", 20 - i) for i in range(10)], "g string, n long")
    got = [tuple(r) for r in rank.top_and_other(g, "g", "n", 4).orderBy("rank").collect()]
    assert got[:3] == [("g0", 20, 1), ("g1", 19, 2), ("g2", 18, 3)] and got[3] == ("…other", sum(20 - i for i in range(3, 10)), 4)
    assert rank.top_and_other(g.limit(3), "g", "n", 4).count() == 3
    groups = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)], "f int, o int")
    assert rows(rank.until_reached(groups, "f", "o", 3)) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_documents(spark, tmp_path):
    s = spark.createDataFrame([("a", "python", "def f(): pass"), ("b", "python", "def f(): pass"), ("c", "java", "int g() {}")], "name string, language string, code string")
    plain = documents.document(s, NullProvider()).collect()
    assert {r["docstring"] for r in plain} == {"No documentation available."}
    cache = DocCache(spark, f"file://{tmp_path}/cache")
    first = {r["name"]: r for r in documents.document(s, HashProvider(), cache).collect()}
    assert first["a"]["details"]["summary"] == first["b"]["details"]["summary"] != first["c"]["details"]["summary"]
    assert not first["a"]["from_cache"] and cache.stats()["languages"] == {"java": 1, "python": 1}
    again = {r["name"]: r for r in documents.document(s, HashProvider(), cache).collect()}
    assert all(r["from_cache"] for r in again.values()) and again["a"]["details"] == first["a"]["details"]
    hits, misses = cache.lookup(spark.createDataFrame([("x",)], "key string"))
    assert hits.count() == 0 and misses.count() == 1
    cache.put(spark.createDataFrame([("k", "python", "1")], "key string, language string, details string"))
    cache.put(spark.createDataFrame([("k", "python", "2")], "key string, language string, details string"))
    assert cache.rows().filter("key = 'k'").first()["details"] == "2"
    cache.clear()
    assert cache.stats()["entries"] == 0 and DocCache(spark, None).stats()["entries"] == 0


class Broken:
    def generate(self, system, prompt, temperature=0.2):
        raise ValueError("no")


def test_provider_errors(spark):
    s = spark.createDataFrame([("a", "python", "x")], "name string, language string, code string")
    assert documents.document(s, Broken()).first()["details"]["summary"] == ""
    vectors = spark.createDataFrame([("a",), (None,)], "t string").select(embed(F.col("t"), HashProvider()).alias("v")).collect()
    assert len(vectors[0]["v"]) == 8


def test_http_provider(monkeypatch):
    import urllib.error

    waits, answers = [], iter([urllib.error.HTTPError("u", 503, "", {}, None), TimeoutError(), {"response": " "}, {"response": "ok"}])

    def post(self, path, body):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    monkeypatch.setattr(HttpProvider, "_post", post)
    assert HttpProvider("http://h", "m", sleep=waits.append).generate("s", "p") == "ok" and waits == [1, 20, 4]
    answers = iter([urllib.error.HTTPError("u", 404, "", {}, None)])
    with pytest.raises(urllib.error.HTTPError):
        HttpProvider("http://h", "m", sleep=waits.append).generate("s", "p")
    answers = iter([OSError()] * 3)
    with pytest.raises(RuntimeError):
        HttpProvider("http://h", "m", tries=3, sleep=waits.append).generate("s", "p")


def test_stubs(spark):
    df = spark.createDataFrame([("f", "(a)", "Does it", ["r.get('/')", "b", "c"])], "n string, s string, d string, decs array<string>")
    row = df.select(examples.signature_stub(F.col("n"), F.col("s"), F.col("d")).alias("x"), examples.decorated_stub(F.col("n"), F.col("s"), F.col("d"), F.col("decs")).alias("y")).first()
    assert row["x"] == '"""Does it"""\ndef f(a):\n    # Function implementation'
    assert row["y"] == "@r.get('/')\n@b\ndef f(a):\n    \"\"\"Does it\"\"\"\n    # Implementation"
