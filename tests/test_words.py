"""Automata and chains give the results of plain search."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.functions import words
from codelake.operators import facts, metrics


@pytest.fixture(scope="module")
def table():
    rng = random.Random(8)
    made = {"".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(12_000)}
    return [*sorted(made)[:9_990], "read", "a", "abab", "bab", "read", "", "東京"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    return ["", None, "ababab", "Read", "東京 read", *("".join(rng.choice("abcdé .") for _ in range(rng.randint(0, 60))) for _ in range(150))]


def test_found(spark, table, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for some in (table, table[:40], table[-7:], [], [""] * 70):
        got = dict(df.select("i", words.found(F.col("t"), some)).collect())
        assert got == {i: None if t is None else [k for k, w in enumerate(some) if w in t] for i, t in enumerate(texts)}
    small = table[-7:-2]
    same = df.select(words.found(F.col("t"), small).alias("a"), words.found(F.col("t"), small, chain=0).alias("b"), words.mentions(F.col("t"), small).alias("c"), words.mentions(F.col("t"), small, chain=0).alias("d"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in same.collect())


def test_elements(spark, table):
    rows = [(0, ["READ_all", "xx", None, "zabcdz"]), (1, []), (2, None), (3, ["q"])]
    df = spark.createDataFrame(rows, "i int, calls array<string>")
    some = ["read", "abcd"]
    for chain in (0, 64):
        assert dict(df.select("i", words.mentioning(F.col("calls"), some, chain)).collect()) == {0: ["READ_all", "zabcdz"], 1: [], 2: None, 3: []}


def test_operators_with_large_tables(spark, table):
    """Ten thousand more words that occur nowhere change nothing."""
    more = [f"zz{i}qq" for i in range(10_000)]
    symbols = spark.createDataFrame([("f", "load", "function", False, ["open_File", "x"]), ("f", "save", "function", True, ["y", "await_it"]), ("g", "z", "method", False, None)], "file_path string, name string, type string, is_async boolean, calls array<string>")
    for run in (lambda w: metrics.data_sources(symbols, w), lambda w: metrics.error_handling(symbols, w), lambda w: metrics.async_patterns(symbols, w)):
        few = ["file", "await", "save"]
        assert sorted(map(tuple, run(few).collect()), key=repr) == sorted(map(tuple, run(few + more).collect()), key=repr)
    names = symbols.select("name")
    features = lambda extra: facts.keyword_features(names, table=[("Loading", ["load", *extra]), ("None", extra), ("Saving", ["save"])]).collect()
    assert features([]) == features(more) and [r["feature"] for r in features(more)] == ["Loading", "Saving"]
    imports = spark.createDataFrame([("flask.app", "x", None), ("os", "Django", None)], "module string, name string, alias string")
    assert [r["name"] for r in facts.frameworks(imports, ["django", "flask", *more]).collect()] == ["django", "flask"]
