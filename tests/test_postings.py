"""The cross-reference index against sets in memory."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import postings
from codelake.operators.numbering import numbered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = {("hot", f"u{i:05}") for i in range(5_000)}
    out |= {(f"r{rng.randrange(30)}", f"u{rng.randrange(5_000):05}") for _ in range(6_000)}
    out |= {("far", "u00000"), ("far", "u04999"), ("one", "u02500"), ("low", "u00001"), ("high", "u04998")}
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark, rows, tmp_path_factory):
    odd = [(None, "u00001"), ("r1", None), *rows[:50]]
    folder = f"file://{tmp_path_factory.mktemp('xref')}/index"
    postings.write(spark.createDataFrame(rows + odd, "ref string, used_by string"), folder)
    return folder


def test_blocks(spark, rows, made):
    named, index = postings.read(spark, made)
    names = {r["number"]: r["used_by"] for r in named.collect()}
    assert [names[i] for i in range(len(names))] == sorted({u for _, u in rows})
    assert sorted((r["ref"], names[r["number"]]) for r in postings.postings(index).collect()) == rows
    found = index.collect()
    assert all(len(r["gaps"]) == r["n"] <= postings.CELL and sum(r["gaps"]) < postings.CELL for r in found)
    assert sum(r["ref"] == "hot" for r in found) == 5 and sum(r["ref"] == "far" for r in found) == 2
    assert {r["ref"]: r["n_users"] for r in postings.counts(index).collect()}["hot"] == 5_000


def test_search(spark, rows, made):
    named, index = postings.read(spark, made)
    asked = {1: ["hot", "r1"], 2: ["r1", "r2"], 3: ["r3", "r4", "hot"], 4: ["hot"], 5: ["low", "high"], 6: ["hot", "unknown"], 7: ["far", "hot"], 8: ["r5", "r5"]}
    wanted = spark.createDataFrame([(q, r) for q, refs in asked.items() for r in refs] + [(9, None), (None, "hot")], "query int, ref string")
    by = {}
    for ref, user in rows:
        by.setdefault(ref, set()).add(user)
    want = sorted((q, u) for q, refs in asked.items() for u in set.intersection(*(by.get(r, set()) for r in refs)))
    got = [(r["query"], r["used_by"]) for r in postings.search(index, wanted, named).filter("query is not null").collect()]
    assert sorted(got) == want
    cells = {(r["query"], r["ref"], r["cell"]) for r in postings.shared_cells(index, wanted).collect()}
    assert not [c for c in cells if c[0] in (5, 6)]  # no cell in common: no gaps are read
    assert {c for c in cells if c[0] == 7} == {(7, ref, cell) for ref in ("far", "hot") for cell in (0, 4)}


def test_skip_entries_read_no_gaps(spark, made):
    index = postings.read(spark, made)[1]
    wanted = spark.createDataFrame([(1, "hot")], "query int, ref string")
    assert "gaps" not in postings.shared_cells(index, wanted)._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    none = spark.createDataFrame([], "ref string, used_by string")
    named = postings.users(none)
    index = postings.blocks(none, named)
    assert index.count() == 0
    assert postings.search(index, spark.createDataFrame([(1, "a")], "query int, ref string"), named).count() == 0


def test_numbered(spark):
    df = spark.range(1_000).select(F.pmod(F.col("id") * 7919, F.lit(1_000)).alias("k"), (F.col("id") % 13).alias("w"), F.col("id").alias("number2"))
    got = numbered(df, ["k"], weight="w").orderBy("k").collect()
    total = 0
    for i, r in enumerate(got):
        assert (r["k"], r["number"], r["w_before"]) == (i, i, total)
        total += r["w"]
    assert numbered(df.limit(0), ["k"], weight="w").count() == 0
