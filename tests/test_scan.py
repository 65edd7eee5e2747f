"""Listing and reading in tasks."""

import os

import pytest
from pyspark.sql import functions as F

from codelake.functions.tables import PRUNED
from codelake.plans import engine
from codelake.sources import scan as scans
from codelake.sources.tree import read_tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("scan")
    for i in range(60):
        at = root / f"pkg{i % 6}" / f"_sub{i % 5}" / ("deep/" * (i % 3))
        at.mkdir(parents=True, exist_ok=True)
        (at / f"_m{i}.py").write_text(f"x = {i}\n" * (i + 1))
        (at / f"f{i}.js").write_bytes("// é\n".encode("latin-1" if i % 2 else "utf-8"))
        (at / f"n{i}.txt").write_text("no source")
    (root / PRUNED[0]).mkdir(exist_ok=True)
    (root / PRUNED[0] / "x.py").write_text("x")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "__init__.py").write_text("")
    os.symlink(root, root / "pkg1" / "loop")
    return str(root)


def plain(df):
    return sorted(tuple(r) for r in df.select("path", "file_ord", "language", "length", "content").collect())


def test_same_rows_as_the_walk(spark, folder):
    want = plain(read_tree(spark, folder))
    assert len(want) == 121
    assert plain(scans.scan(spark, folder)) == want
    assert plain(scans.scan(spark, folder, folder, folder + "/pkg1", folders=1, chunk=9_000)) == want  # rounds, small tasks, roots inside each other
    assert sorted(r["path"] for r in scans.scan(spark, "file://" + folder).collect()) == ["file://" + w[0] for w in want]
    assert sorted(r["path"] for r in scans.scan(spark, folder, prune=["pkg1"], most=60).collect()) == [w[0] for w in plain(read_tree(spark, folder, prune="pkg1", maxbytes="60"))]


def test_tasks_hold_a_chunk(spark, folder):
    rows = scans.scan(spark, folder, chunk=20_000).select("length", F.spark_partition_id().alias("p")).groupBy("p").agg(F.sum(F.col("length") + 4096).alias("n"), F.max("length").alias("m")).collect()
    assert len(rows) > 5 and all(r["n"] <= 20_000 + 4096 + r["m"] for r in rows)


def test_content_is_read_only_where_it_is_needed(spark, folder, tmp_path):
    """Files that vanish after the listing show which of them a query reads."""
    for i in range(20):
        (tmp_path / f"m{i}.py").write_text("y" * (i + 1))
    df = scans.scan(spark, str(tmp_path))
    for i in range(10):
        (tmp_path / f"m{i}.py").unlink()
    assert df.select("path", "length").count() == 20
    assert [r["content"] for r in df.orderBy("length").collect()] == [None] * 10 + ["y" * (i + 1) for i in range(10, 20)]

    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "_content" in plan(df) and "_content" not in plan(df.select("path", "length")) and "_content" not in plan(df.groupBy("language").count())
    few = df.filter("language = 'python' and length > 15 and path like '%m1%'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        text = plan(few)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(length,15)" in text and "EqualTo(language,python)" in text
    assert text.index("_content") < text.index("PushedFilters")  # plans are printed from the result down
    assert sorted(r["content"] for r in few.collect()) == ["y" * n for n in range(16, 21)]


def test_project_from_a_scan(spark, folder):
    local, address = engine.build(spark, folder), engine.build(spark, "file://" + folder, files=scans.scan(spark, "file://" + folder))
    for table in ("files", "variables"):
        keys = [c for c in ("path", "file_ord", "language", "name", "value") if c in local.tables[table].columns]
        rows = [sorted(map(repr, p.tables[table].select(*keys).collect())) for p in (local, address)]
        assert rows[0] == rows[1] and rows[0]


def test_odd_roots(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert scans.scan(spark, str(tmp_path / "empty")).count() == 0
    rows = scans.listing(spark, str(tmp_path / "missing"), str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["path"].endswith("missing") and rows[0]["error"]
    assert scans.scan(spark, str(tmp_path / "missing")).count() == 0
