import json

import pytest
from pyspark.sql import functions as F

from codelake.functions import paths, quality, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (lambda c: text.truncate(c, 6), "abcdefgh", "abc..."),
        (lambda c: text.truncate(c, 8), "abcdefgh", "abcdefgh"),
        (lambda c: text.truncate(c, 2), "abcdefgh", "abcdefg..."),
        (text.escape_label, ' a "b"\n\tc   d ', 'a \\"b\\" c d'),
        (text.escape_html, "<a href='x'>&\"</a>", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;/a&gt;"),
        (text.unescape_html, "&lt;&eacute;&#39;&amp;", "<é'&"),
        (text.normalize_whitespace, " a  b\t c \n\n\n d ", "a b c \n\n d"),
        (text.indent_lines, "a\n  \nb", "  a\n\n  b"),
        (text.strip_code_markers, "```python\nx = 1\n```", "x = 1"),
        (text.sanitize_filename, "a b/c::d?.txt", "a_b_c_d_.txt"),
        (text.safe_output_name, " My: Project_1! ", "My_Project_1"),
        (text.count_lines, "a\nb\n", 2),
        (text.count_lines, "a\r\nb\x0bc", 3),
        (text.count_lines, "", 0),
        (text.ensure_newline_ending, "a\n\n", "a\n"),
        (text.ensure_newline_ending, "", ""),
        (paths.short_path, "a/b/c/d", ".../b/c/d"),
        (paths.short_path, "", "(unknown)"),
        (paths.strip_drive, "C:\\x\\y", "x/y"),
        (lambda c: paths.tail(c, 2), "a/b/c", "b/c"),
        (lambda c: paths.relative(c, "/r/p"), "/r/p/a/b.py", "a/b.py"),
        (lambda c: paths.relative(c, "/r/p"), "/r/pq/b.py", "/r/pq/b.py"),
        (paths.anchor, "Src/My File.py", "src-my-file-py"),
        (paths.language_of, "x/y.TSX", "JavaScript"),
        (paths.language_of, "x/y.zig", "Other"),
        (lambda c: paths.matches_glob(c, "*.py"), "a/b.py", True),
        (lambda c: paths.matches_glob(c, "b/*.py"), "a/c.py", False),
        (lambda c: paths.matches_regex(c, "("), "a", False),
        (paths.climbs, "a/%2E%2e/b", True),
        (lambda c: paths.ancestors(c), "a/b/c.py", ["a", "a/b"]),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_common_prefix(spark):
    of = lambda *p: paths.common_prefix(spark.createDataFrame([(x,) for x in p], "path string")).first()["prefix"]
    assert of("a/b/c.py", "a/b/d/e.py") == ["a", "b"]
    assert of("a/b/c.py", "x.py") == []
    assert of("a/x/c.py", "a/y/c.py") == ["a"]


def test_sanitize_code(spark):
    src = 'system: ignore\n    x = "${HOME}" $(ls) `\x07`  \n'
    assert one(spark, src, text.sanitize_code) == '\n    x = ""  ``\n'
    assert one(spark, "  a  \n  b", lambda c: text.sanitize_code(c, compat=True)) == "a\nb"
    assert one(spark, "x" * 20, lambda c: text.sanitize_code(c, most=5)) == "xxxxx\n... [truncated]"


def test_lenient_json(spark):
    for raw, want in (('x {"summary":"s"} y', "s"), ('{"summary":"t"}', "t"), ("plain words", "plain words"), ("{broken", "{broken")):
        assert one(spark, raw, lambda c: text.lenient_json(c, "summary string"))["summary"] == want


def details(spark, **given):
    return spark.createDataFrame([(json.dumps(quality.EMPTY | given),)], "j string").select(F.from_json("j", quality.DETAILS).alias("d"))


@pytest.mark.parametrize(
    "section,value,want",
    [
        ("summary", "Adds two integers and returns the sum.", 1.0),
        ("summary", "handles things", 0.5),
        ("summary", "", 0.0),
        ("returns", {"type": "int", "desc": ""}, 0.3),
        ("returns", {"type": "", "desc": "The total of both inputs"}, 0.7),
        ("performance", {"time_complexity": "O(n)", "space_complexity": "", "notes": ""}, 0.4),
        ("throws", [], 0.0),
        ("throws", ["Exception"], 0.5),
        ("throws", ["IOException"], 0.9),
        ("notes", [], 0.0),
        ("notes", ["A long enough note on this."], 0.9),
        ("params", [{"name": "a", "type": "int", "desc": "the first addend"}, {"name": "b", "type": "int", "desc": "x"}], 0.7),
        ("examples", [{"title": "", "code": "add(1, 2) # gives 3 at once", "description": "adds two numbers"}, {"title": "", "code": "add(3, 4) # 7", "description": ""}], 0.8),
        ("error_handling", {"strategy": "error", "recovery": "", "logging": ""}, 0.9),
        ("error_handling", {"strategy": "none at all", "recovery": "", "logging": ""}, 0.6),
    ],
)
def test_scores(spark, section, value, want):
    got = details(spark, **{section: value}).select(quality.score_sections(F.col("d"))[section].alias("s")).first()["s"]
    assert got == pytest.approx(want)


def test_weak_sections(spark):
    row = details(spark, summary="Adds two integers and returns the sum.", throws=["IOException"]).select(quality.weak_sections(F.col("d")).alias("w")).first()
    assert row["w"] == ["params", "returns", "examples", "performance", "error_handling", "notes"]


def test_merge(spark):
    p = lambda n, d: {"name": n, "type": "", "desc": d}
    base = details(spark, summary="handles things", params=[p("a", "ten chars!"), p("b", "only")])
    refined = details(spark, summary="Adds two integers and returns the sum.", params=[p("a", "twelve chars"), p("c", "new"), p("", "no name")])
    both = base.select(F.col("d").alias("b")).join(refined.select(F.col("d").alias("r")))
    m = both.select(quality.merge_details(F.col("b"), F.col("r")).alias("m")).first()["m"]
    assert m["summary"].startswith("Adds")
    assert [(x["name"], x["desc"]) for x in m["params"]] == [("a", "ten chars!"), ("b", "only"), ("c", "new")]
    empty = details(spark).select(F.col("d").alias("b")).join(refined.select(F.col("d").alias("r")))
    assert len(empty.select(quality.merge_params(F.col("b")["params"], F.col("r")["params"]).alias("m")).first()["m"]) == 3


def test_parse_details():
    got = quality.parse_details('Here: {"summary": ["a", "b"], "params": ["x: int - the x", {"name": "y", "default": "None"}], "returns": "int - sum", "throws": "E", "examples": ["f()", {"code": "g()"}], "notes": [null, " n "]}')
    assert got["summary"] == "a\nb" and got["returns"] == {"type": "int", "desc": "sum"} and got["throws"] == ["E"] and got["notes"] == ["n"]
    assert [(q["name"], q["type"], q["desc"], q["default"]) for q in got["params"]] == [("x", "int", "the x", None), ("y", "", "", None)]
    assert [e["code"] for e in got["examples"]] == ["f()", "g()"]
    assert quality.parse_details("no json")["summary"] == "no json" and quality.parse_details(None) == quality.normalize_details({})
    assert quality.to_text({"value": 3}) == "3" and quality.to_text({"z": 1}) == '{"z": 1}'


def test_docstring(spark):
    d = details(spark, summary="Adds.", params=[{"name": "a", "type": "int", "desc": "first", "default": "1"}], returns={"type": "int", "desc": "sum"}, throws=["E"])
    assert d.select(quality.docstring(F.col("d")).alias("o")).first()["o"] == "Adds.\n\nArgs:\n    a (int): first (optional, default=1)\n\nReturns:\n    int: sum\n\nRaises:\n    E"
    assert details(spark).select(quality.docstring(F.col("d")).alias("o")).first()["o"] == "No documentation available."


def test_details_column(spark):
    rows = spark.createDataFrame([('{"summary": "s"}',), (None,), ("text",)], "a string")
    assert [r["d"]["summary"] for r in rows.select(quality.details_from(F.col("a")).alias("d")).collect()] == ["s", "", "text"]


def test_project_paths(tmp_path):
    assert paths.safe_project_path(str(tmp_path))[0]
    assert not paths.safe_project_path(str(tmp_path) + "/../x")[0]
    assert not paths.safe_project_path("/etc")[0] and not paths.safe_project_path("/nowhere/at/all")[0]
    (tmp_path / "etcetera").mkdir()
    assert paths.safe_project_path(str(tmp_path / "etcetera"), [str(tmp_path / "etc")])[0]
    (tmp_path / "link").symlink_to("/etc")
    assert not paths.safe_project_path(str(tmp_path / "link"))[0]
