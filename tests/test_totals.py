"""Totals by deltas against rebuilds."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import facts
from codelake.operators.totals import ROW, FactTotals, contributions


@pytest.fixture
def store(spark, tmp_path):
    return FactTotals(spark, f"file://{tmp_path}/totals")


def rows_of(state):
    return [(p, *r) for p, rows in state.items() for r in rows]


def rebuilt(state):
    out = {}
    for _, fact, key, value in rows_of(state):
        out[fact, key] = out.get((fact, key), 0) + value
    return {k: v for k, v in out.items() if v}


def current(store):
    return {(r["fact"], r["key"]): r["value"] for r in store.totals().collect()}


def test_updates_and_deletes_equal_a_rebuild(spark, store):
    rng = random.Random(6)
    state = {}
    made = lambda: [(rng.choice("ab"), rng.choice(("x", "y", None)), rng.randint(-3, 9)) for _ in range(rng.randint(1, 5))]
    for step in range(4):
        changed = {f"f{rng.randrange(30)}": made() for _ in range(12)}
        gone = [f"f{i}" for i in range(30) if rng.random() < 0.2 and f"f{i}" not in changed]
        args = (f"b{step}", spark.createDataFrame(rows_of(changed), ROW), spark.createDataFrame([(g,) for g in [*gone, *gone, next(iter(changed))]], "path string"))
        assert store.apply(*args) and not store.apply(*args)
        state = {p: r for p, r in (state | changed).items() if p not in gone}
        assert current(store) == rebuilt(state)
        if step == 1:
            assert store.compact() and current(store) == rebuilt(state) and not store.apply(*args)


def test_two_writers(spark, store):
    """A writer that worked on an older state does not commit it, but works it out again."""
    one = lambda v: spark.createDataFrame([("f", "n", "", v)], ROW)
    store.apply("first", one(1))
    other, plain, calls = FactTotals(spark, store.path), store._write, []

    def slow(rows):
        folder = plain(rows)
        if not calls:
            calls.append(1)
            assert other.apply("theirs", one(10))
        return folder

    store._write = slow
    assert store.apply("mine", one(100))
    assert current(store) == {("n", ""): 100}
    assert [c["batches"] for c in store.commits()] == [["first"], ["theirs"], ["mine"]]


def test_broken_write_is_not_seen(spark, store):
    store.apply("a", spark.createDataFrame([("f", "n", "", 1)], ROW))
    store._write(spark.createDataFrame([("f", "n", "", 7)], ROW))  # a writer that died before its commit
    assert current(store) == {("n", ""): 1}
    assert store.apply("b", spark.createDataFrame([], ROW)) and current(store) == {("n", ""): 1}


def test_empty(spark, store):
    assert current(store) == {} and not store.compact()
    assert store.apply("none", spark.createDataFrame([], ROW), spark.createDataFrame([(None,), ("x",)], "path string")) and current(store) == {}
    assert store.highest().first()["highest"] is None


def test_facts_of_files(spark, store):
    schema = "path string, n_functions int, n_classes int, n_imports int"
    old = [("a/b/x.py", 3, 1, 2), ("a/y.js", 1, 0, 0), ("z.py", 2, 2, 2)]
    new = [("a/b/x.py", 1, 1, 1), ("a/c/w.py", 5, None, 0), ("z.py", 2, 2, 2)]
    symbols = lambda rows: spark.createDataFrame(rows, "path string, cyclomatic int")
    store.apply("1", contributions(spark.createDataFrame(old, schema), symbols([("a/b/x.py", 40), ("a/b/x.py", 2), ("z.py", 2)])))
    assert store.highest().first()["highest"] == 40
    store.apply("2", contributions(spark.createDataFrame(new[:2], schema), symbols([("a/b/x.py", 2)])), spark.createDataFrame([("a/y.js",)], "path string"))
    got, files = current(store), spark.createDataFrame(new, schema)
    assert (got["files", ""], got["functions", ""], got["classes", ""], got["imports", ""]) == (3, 8, 3, 3)
    assert {k: v for (f, k), v in got.items() if f == "directory"} == {r["dir"]: r["n_files"] for r in facts.directory_rollup(files).collect()}
    assert {k: v for (f, k), v in got.items() if f == "language"} and store.highest().first()["highest"] == 2
    assert {k: v for (f, k), v in got.items() if f == "complexity"} == {"2": 2}
