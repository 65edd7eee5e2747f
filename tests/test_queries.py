"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from codelake import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) if isinstance(v, float) else v


def test_all_queries_have_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(oracle.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_result_does_not_depend_on_partitions(spark):
    names = ("importance_rank", "group_top_other", "folder_nodes", "xref_index", "dependency_diagram")
    rows = {n: sorted(map(tuple, queries.queries()[n](spark, SF).collect())) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows == {n: sorted(map(tuple, queries.queries()[n](spark, SF).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
