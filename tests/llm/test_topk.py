import math

import numpy as np
import pytest

from codelake.llm import topk
from codelake.llm.queries import op9_topk


def brute(rows, queries, k):
    out = []
    for qi, qv in queries:
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in rows if i != qi and len(v) == len(qv))
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, queries, k, **options):
    frame = lambda x: spark.createDataFrame([(i, [int(c) for c in v]) for i, v in x], "vec_id long, v array<bigint>")
    return sorted(map(tuple, topk.top_k(frame(rows), frame(queries), k, **options).collect()))


@pytest.mark.parametrize("shard_rows,block_bytes", [(10_000, 1 << 20), (97, 8 * 12 * 13), (20, 1 << 20)])
def test_against_brute_force(spark, shard_rows, block_bytes):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-40, 40, 12).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [(2000, [0] * 12), (2001, [0] * 12)]
    queries = [r for r in rows if r[0] % 50 == 0]
    assert run(spark, rows, queries, 5, shard_rows=shard_rows, block_bytes=block_bytes) == brute(rows, queries, 5)


def test_ties_and_few(spark):
    rows = [(i, [1, 1]) for i in (50, 3, 9, 100, 4, 5, 6)]
    assert run(spark, rows, [(50, [1, 1]), (100, [1, 1])], 5) == brute(rows, [(50, [1, 1]), (100, [1, 1])], 5)
    assert run(spark, [(50, [1, 2])], [(50, [1, 2])], 5) == []
    mixed = [(50, [1, 2]), (1, [3, 4]), (2, [1, 2, 3])]
    assert run(spark, mixed, mixed[:1], 5) == [(50, 1, 1, 11)]


def test_unusable_vectors(spark):
    rows = [(0, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (0, [0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = topk.integers(df)
    assert sorted(r["vec_id"] for r in ints.collect()) == [0, 0, 5]
    assert sorted(map(tuple, topk.top_k(ints, ints.filter("vec_id = 0"), 5).collect())) == [(0, 1, 5, 16384)]
    none = topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none, 5).count() == 0


def test_large_components(spark):
    """Products beyond 2**53 are exact, and those beyond long take its nearest end."""
    rng = np.random.default_rng(8)
    for top, dim in ((1 << 27, 64), (1 << 30, 4), (1 << 62, 3)):
        rows = [(i, rng.integers(-top, top, dim).tolist()) for i in range(150)]
        rows.append((500, rows[3][1]))
        queries = [r for r in rows if r[0] % 50 == 0]
        got = run(spark, rows, queries, 5, shard_rows=40)
        ends = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        want = []
        for qi, qv in queries:
            scored = sorted((-ends(sum(a * b for a, b in zip(qv, v, strict=True))), i) for i, v in rows if i != qi)
            want += [(qi, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
        assert got == sorted(want)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(i, [i % 7, -i, 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    more = df.withColumns({n: F.lit("x") for n in ("shard", "h", "ids", "salt", "nth", "dim", "score", "rank", "query_id", "block", "points")})
    assert sorted(map(tuple, topk.top_k(more, more.filter("vec_id % 10 = 0"), 3).collect())) == brute(rows, [r for r in rows if r[0] % 10 == 0], 3)


def test_bounds_hold():
    """Every node bounds all products below it, its children share its rows, and leaves make up the tree."""
    rng = np.random.default_rng(0)
    points, queries = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (20, 16))
    tree, order = topk.BallTree.build(points, leaf=20)
    assert (tree.points == points[order]).all()
    length = np.sqrt((queries.astype(float) ** 2).sum(1))
    for node, (lo, hi) in enumerate(tree.span):
        bound = tree.bounds(queries.astype(float), length, np.full(20, node))
        assert (queries @ tree.points[lo:hi].T <= bound[:, None]).all()
        if tree.child[node, 0] >= 0:
            a, b = tree.child[node]
            assert (tree.span[a][0], tree.span[a][1], tree.span[b][1]) == (lo, tree.span[b][0], hi)
        else:
            assert hi - lo <= 20


def test_inner_nodes_are_cut():
    """On points in clusters far apart, most leaves are never scored; a shared kth score cuts more."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-20, 20, (64, 8)) + rng.integers(-5000, 5000, 8) for _ in range(64)])
    queries = points[::50]
    tree, order = topk.BallTree.build(points)
    first = np.arange(len(points) + 1)
    best = topk.Best(np.full(len(queries), -1), queries, np.full(len(queries), topk.LOWEST), 5)
    scored = best.search(tree, order, first)
    leaves = (tree.child[:, 0] < 0).sum()
    assert scored < 0.5 * leaves * len(queries)
    again = topk.Best(np.full(len(queries), -1), queries, best.kth, 5)
    assert again.search(tree, order, first) <= scored
    exact = np.sort(queries @ points.T, 1)[:, :-6:-1]
    assert (best.found[1].reshape(-1, 5) == exact).all()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op9_topk(spark, sf).collect())) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)


@pytest.mark.parametrize("shard_rows,block_bytes", [(10_000, 1 << 20), (23, 8 * 6 * 9), (1, 1 << 20)])
def test_ids_with_several_vectors(spark, shard_rows, block_bytes):
    """An id of one to seven vectors takes one place, with its best score, also as a query."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 9, 6).tolist()) for i in range(0, 120) for _ in range(1 + i % 7)]
    rows += [(7, [9 + k, 9, 9, 9, 9, 9]) for k in range(6)] + [(50, [9] * 6)] + rows[:20]
    queries = [r for r in rows if r[0] % 50 == 0]
    best = {}
    for qi, qv in queries:
        for i, v in rows:
            if i != qi:
                best[qi, i] = max(best.get((qi, i), -(1 << 62)), sum(a * b for a, b in zip(qv, v, strict=True)))
    want = []
    for q in {qi for qi, _ in queries}:
        scored = sorted((-s, i) for (qi, i), s in best.items() if qi == q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    assert run(spark, rows, queries, 5, shard_rows=shard_rows, block_bytes=block_bytes) == sorted(want)
    few = [(7, [k, 1]) for k in range(6)] + [(8, [0, 1]), (9, [0, 1]), (50, [1, 1])]
    assert run(spark, few, few[-1:], 5) == [(50, 1, 7, 6), (50, 2, 8, 1), (50, 3, 9, 1)]
