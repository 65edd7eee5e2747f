"""Parsers on small sources."""

import pyarrow as pa
import pytest

from codelake import queries
from codelake.operators import extraction
from codelake.sources.extract import PARSERS, docs, java, python, register, script

PY = '''import os
from pkg.core import run as go
MAX = 3
mode = "x"

@deco
async def fetch(u, *, n: int = 1) -> str:
    for i in range(n):
        if u and i:
            go(u)
    return u

class Box(Base):
    size: int = 0
    def __init__(self): pass
    def _hid(self): pass
    @staticmethod
    def open(): pass
'''


def by_name(rows):
    return {r["name"]: r for r in rows}


def test_python():
    got = python.parse(PY)
    assert [(i["type"], i["module"], i["name"], i["alias"], i["level"], i["line"]) for i in got["imports"]] == [("import", "os", None, None, 0, 1), ("from_import", "pkg.core", "run", "go", 0, 2)]
    assert [(v["owner"], v["kind"], v["name"], v["type"], v["value"], v["line"]) for v in got["variables"]] == [(None, "constant", "MAX", "int", "3", 3), (None, "global", "mode", "str", "'x'", 4), ("Box", "attribute", "size", "int", "0", 14)]
    s = by_name(got["symbols"])
    f = s["fetch"]
    assert f["signature"] == "(u, *, n=1)" and f["async"] and f["decorators"] == ["deco"] and f["returns"]["type"] == "Coroutine[str]"
    assert f["function_calls"] == ["go", "range"] and f["lines"] == {"start": 7, "end": 11}
    assert f["complexity"] == {"cyclomatic": 4, "nesting_depth": 2, "num_branches": 1, "num_loops": 1}
    box = got["classes"][0]
    assert (box["name"], box["extends"], box["n_methods"], box["lines"]) == ("Box", "Base", 3, {"start": 13, "end": 18})
    assert s["__init__"]["is_constructor"] and s["_hid"]["is_protected"] and s["open"]["is_public"] and s["open"]["is_static"]


def test_python_details():
    got = python.parse('def f(a, b=1, /, *args, c: int, d="x", **kw):\n    """Do.\n\n    Args:\n        a (int): the a\n            and more\n        c: the c\n\n    Returns:\n        bool: whether\n\n    Raises:\n        ValueError: never\n    """\n    return [x for x in a]\n')
    f = got["symbols"][0]
    assert f["signature"] == "(a, b=1, *args, c, d='x', **kw)" and [p["name"] for p in f["parameters"]] == ["a", "b", "*args", "c", "d", "**kw"]
    assert f["description"] == "Do." and f["returns"] == {"type": "bool", "description": "whether"} and f["throws"] == ["ValueError"]
    assert f["parameters"][0]["description"] == "the a and more" and f["parameters"][0]["type"] == "int" and f["parameters"][3]["type"] == "int"
    with pytest.raises(SyntaxError):
        python.parse("def f(:")
    assert python.main_block('x = 1\nif __name__ == "__main__":\n    a()\n\n    b()\n') == "a()\nb()" and python.main_block("x = 1") is None
    types = {v["name"]: v["type"] for v in python.parse("A = [1]\nB = {}\nC = {1}\nD = (1,)\nE = None\nF = lambda: 1\nG = 1.5\nH = b''\nI = True\nJ = f()\n")["variables"]}
    assert types == {"A": "list", "B": "dict", "C": "set", "D": "tuple", "E": "None", "F": "function", "G": "float", "H": "bytes", "I": "bool", "J": ""}


JS = '''/** The file.
 * Second line. */
import x from "mod";
/**
 * Adds numbers.
 * @param {number} a - first
 * @param {number} [b=2] second
 * @returns {number} the sum
 */
function add(a, b = 2, ...rest) { return a + b; }
export async function load({ id, name }, [x]) { const s = "}"; /* } */ return `${s}}`; }
function* gen() { yield /[}]/.test("}"); }
const block = (a) => { return a; };
export const expr = async a => a + 1;
let old = function (z) { return z; };
export class Calc extends Base.Core {
  #hidden = () => { if (1) {} };
  constructor(a) { super(a); }
  static make(x) { if (x) { for (;;) { break; } } return new Calc(x); }
  get size() { return 1; }
  async go(a = foo(1, 2)) { switch (a) { default: } }
}
const outside = 1;
'''


def test_javascript():
    got = script.parse_javascript(JS)
    s = by_name(got["symbols"])
    assert set(s) == {"add", "load", "gen", "block", "expr", "old", "constructor", "make", "size", "go"}
    assert s["add"]["description"] == "Adds numbers." and s["add"]["returns"] == {"type": "number", "description": "the sum"}
    assert [(p["name"], p["type"], p["default"], p["description"]) for p in s["add"]["parameters"]] == [("a", "number", None, "first"), ("b", "number", "2", "second"), ("...rest", "Array", None, "")]
    assert s["load"]["async"] and s["load"]["exported"] and [p["name"] for p in s["load"]["parameters"]] == ["{...}", "[...]"]
    assert s["gen"]["generator"] and s["gen"]["signature"] == "*()" and s["block"]["arrow"] and s["expr"]["async"] and s["expr"]["exported"]
    assert s["add"]["lines"] == {"start": 10, "end": 10} and s["load"]["lines"] == {"start": 11, "end": 11}
    assert s["make"]["is_static"] and s["size"]["method_kind"] == "get" and s["constructor"]["description"] == "Constructs a Calc instance."
    assert got["classes"][0]["extends"] == "Base.Core" and got["classes"][0]["lines"] == {"start": 16, "end": 22} and got["classes"][0]["n_methods"] == 4
    assert got["summary"].startswith("The file.") and got["imports"][0]["module"] == "mod"


TS = '''import { A } from './a';
const ünïcode = "ß";
export const subtract = (a: number, b: number): number => { return a - b; };
function add(a: number, b?: string, c: Map<string, number> = new Map()): Promise<string> { return x; }
interface ICalc { multiply(a: number): number; name: string; }
export abstract class Calculator extends Base<T> implements ICalc {
  private total: number = 0;
  constructor(private readonly start: number) { super(); }
  public multiply(a: number): number { if (a) { return 1; } return a; }
  protected static async helper(...xs: string[]): Promise<void> { }
}
'''


def test_typescript():
    got = script.parse_typescript(TS)
    s = {(r["class_name"], r["name"]): r for r in got["symbols"]}
    assert set(s) == {(None, "subtract"), (None, "add"), ("ICalc", "multiply"), ("Calculator", "constructor"), ("Calculator", "multiply"), ("Calculator", "helper")}
    add = s[None, "add"]
    assert [(p["name"], p["type"], p["optional"], p["default"]) for p in add["parameters"]] == [("a", "number", False, None), ("b", "string", True, None), ("c", "Map<string, number>", True, "new Map()")]
    assert add["returns"]["type"] == "Promise<string>" and s[None, "subtract"]["arrow"] and s[None, "subtract"]["exported"]
    assert s["Calculator", "constructor"]["description"] == "Creates a new instance of Calculator." and s["Calculator", "helper"]["is_protected"]
    assert [p["name"] for p in s["Calculator", "constructor"]["parameters"]] == ["start"] and s["Calculator", "helper"]["parameters"][0]["rest"]
    assert {c["name"]: c["extends"] for c in got["classes"]} == {"ICalc": "", "Calculator": "Base"}
    assert script.parse_typescript("function f(a) {}")["symbols"][0]["parameters"][0]["type"] == "any"


JAVA = '''package p;
import java.util.List;
/** A calculator. */
public class Calc<T> extends Base<T> implements Runnable {
  private int x = compute(3);
  static { init(); }
  /** Makes one. */
  public Calc(int x) { this.x = x; }
  /**
   * Adds {@code a} and b. More.
   * @param a first number
   * @param b second
   * @return the sum
   * @throws IllegalStateException never
   */
  @Override
  public static final int add(int a, final List<String> b, String... rest) throws java.io.IOException, Foo { if (a > 1) { return sub(a); } return 1; }
  private Map<String, Integer> sub(int a) { return new HashMap<>() {{ put("}", 1); }}; }
  interface Inner { void go(); }
}
'''


def test_java():
    got = java.parse(JAVA)
    assert [(r["class_name"], r["name"]) for r in got["symbols"]] == [("Calc", "add"), ("Calc", "sub"), ("Calc", "Calc"), ("Inner", "go")]
    add = got["symbols"][0]
    assert add["signature"] == "(int a, List b, String rest)" and add["throws"] == ["java.io.IOException", "Foo"] and add["modifiers"] == ["final", "public", "static"]
    assert add["description"].startswith("Adds a and b.") and add["parameters"][0]["description"] == "first number" and add["returns"] == {"type": "int", "description": "the sum"}
    assert got["symbols"][2]["is_constructor"] and got["classes"][0]["extends"] == "Base" and got["classes"][0]["description"] == "A calculator."
    assert got["imports"][0]["module"] == "java.util.List" and add["lines"]["start"] == 17


def test_doc_comments():
    g = docs.google("Check it.\n\nArgs:\n    x (int): number\n    y (str): text\n\nReturns:\n    bool: fine")
    assert [(p["name"], p["type"]) for p in g["params"]] == [("x", "int"), ("y", "str")] and g["returns"]["type"] == "bool"
    j = docs.jsdoc("/**\n * Does it.\n * @param {{a: number}} o - options\n * @returns {Promise<string>} later\n * @throws {Error} bad\n */")
    assert j["params"] == [{"name": "o", "type": "{a: number}", "description": "options"}] and j["returns"]["type"] == "Promise<string>" and j["throws"] == ["Error"]
    d = docs.javadoc("/** First sentence. Second. @param no tag here */")
    assert d["brief"] == "First sentence." and docs.brief("") == "" and docs.google(None)["description"] == ""


def test_registry():
    register("toy", lambda content: {"symbols": []})
    try:
        assert PARSERS["toy"]("x") == {"symbols": []}
    finally:
        del PARSERS["toy"]


def test_rows_of_a_few_files_at_a_time():
    """A task's memory does not grow with the files it is given; equal sources are parsed once; every file has its row."""
    asked = []

    def toy(content):
        asked.append(content)
        if content == "bad":
            raise ValueError(content)
        return {"summary": content}

    sources = ["a", "b", "bad", None] * 250
    files = pa.RecordBatch.from_pylist([{"path": f"p{i}", "file_ord": i, "language": "toy", "content": c} for i, c in enumerate(sources)])
    kinds = pa.schema([("path", pa.string()), ("file_ord", pa.int32()), ("language", pa.string()), ("summary", pa.string()), ("error", pa.string())])
    pieces = list(extraction._batches([files], {"toy": toy}, kinds))
    assert max(p.num_rows for p in pieces) <= 256
    rows = [r for p in pieces for r in p.to_pylist()]
    want = {"a": ("a", None), "b": ("b", None), "bad": (None, "ValueError: bad"), None: ("", None)}
    assert [(r["path"], r["summary"], r["error"]) for r in rows] == [(f"p{i}", *want[c]) for i, c in enumerate(sources)]
    assert sorted(asked) == ["", "a", "b", "bad"]


def test_kept_sources_are_bounded():
    big = ["x" * 400_000 + str(i % 4) for i in range(12)]
    files = pa.RecordBatch.from_pylist([{"path": f"p{i}", "file_ord": i, "language": "toy", "content": c} for i, c in enumerate(big)])
    kinds = pa.schema([("path", pa.string()), ("summary", pa.string())])
    pieces = list(extraction._batches([files], {"toy": lambda c: {"summary": c[-1]}}, kinds))
    assert len(pieces) > 1 and [r["summary"] for p in pieces for r in p.to_pylist()] == [c[-1] for c in big]


def test_deep_expressions():
    row = python.parse("def f(a):\n    return " + " + ".join(["g(a)"] * 1500) + "\n")["symbols"][0]
    assert row["function_calls"] == ["g"] and row["complexity"]["nesting_depth"] == 0


def test_parts_are_dealt_to_cores(spark):
    for name in ("python_symbols", "js_symbols", "ts_symbols", "java_symbols"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8
