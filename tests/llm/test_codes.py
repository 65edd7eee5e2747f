import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from codelake.llm import codes
from codelake.llm.queries import op12_codes


def brute(rows, rounds=4):
    """Plain Lloyd rounds over (vec_id, vector, label)."""
    rows = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    w = len(rows[0][1]) // 4
    parts = [[tuple(v[p * w : (p + 1) * w]) for _, v, _ in rows] for p in range(4)]
    books = [own[:256] for own in parts]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((away(x, z), k) for k, z in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            own = defaultdict(list)
            for x in parts[p]:
                own[nearest(x, books[p])[1]].append(x)
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if k in own else z for k, z in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for book in books for z in book for c in z).encode()).hexdigest()
    out, labels = [], defaultdict(int)
    for k, (i, _, label) in enumerate(rows):
        found = [nearest(parts[p][k], books[p]) for p in range(4)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), min(codes.MOST, sum(d for d, _ in found))))
        labels[label] += out[-1][3]
    return sorted((str((*r, min(codes.MOST, labels[r[1]]), sha)) for r in out))


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(parts)
    return sorted(str(tuple(r)) for r in codes.compress(df, **options).collect())


@pytest.mark.parametrize("shard_rows", [16_384, 70])
def test_against_plain_lloyd(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) + rng.integers(0, 3)).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(1000 + i, rows[7][1], None) for i in range(200)]  # copies: one node, assigned at once
    assert run(spark, rows, shard_rows=shard_rows) == brute(rows)


def test_ties_and_few_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 90, (rng.integers(-2, 3, 8) / 1024).tolist(), i % 2) for i in range(400)]  # repeated ids, equal entries, ties everywhere
    assert run(spark, rows, shard_rows=50) == brute(rows)
    assert run(spark, rows[:1]) == brute(rows[:1])


@pytest.mark.parametrize("top", [3e3, 1e5, 1e9, 1e14, 1e300])
def test_large_components(spark, top):
    """Beyond exact floats, then beyond 64 bits; beyond long a component takes its nearest end."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.uniform(-top, top, 8)).tolist(), None) for i in range(60)]
    rows += [(500 + i, rows[3][1], 1) for i in range(40)]
    ends = lambda x: max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x)))
    want = brute([(i, [ends(x) / 1024 for x in v], label) for i, v, label in rows]) if top < 1e12 else None
    got = run(spark, rows, shard_rows=33)
    assert len(got) == 100 and (want is None or got == want)


def test_unusable_vectors(spark):
    ok = [0.5, -0.25, 1.0, 3.0]
    rows = [(0, ok, 1), (1, None, 1), (2, [None, 1.0, 1.0, 1.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf")] * 4, 1), (5, [1.0] * 5, 1), (6, [], 1), (7, [1.0] * 8, 1), (None, ok, 2), (0, ok, 1)]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, rows)) == 3
    assert run(spark, rows[1:7]) == []
    assert codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label string")).count() == 0


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    more = df.withColumns({n: F.lit("x") for n in ("v", "n", "hot", "own", "code", "error", "label_error", "part", "entry", "kind", "points")})
    assert sorted(str(tuple(r)) for r in codes.compress(more).collect()) == brute(rows)


def test_boxes_eliminate():
    """On clusters most subtrees are assigned as a whole; a box that is one point always is."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-9, 9, (200, 4)) + rng.integers(-90_000, 90_000, 4) for _ in range(40)] + [np.zeros((999, 4), np.int64)])
    book = points[::200][:41]
    tree = codes.PartTree.build(points)
    whole, single, met = tree.filter(book)
    entry, away = tree.assigned(book)
    exact = ((points[:, None, :] - book[None]) ** 2).sum(2)
    assert (entry == exact.argmin(1)).all() and (away == exact.min(1)).all()
    assert met < 0.02 * exact.size
    assert sum(tree.span[n, 1] - tree.span[n, 0] for n, _ in whole) > 0.9 * len(points)
    count, total = tree.gathered(book)
    assert (count == np.bincount(entry, minlength=len(book))).all()
    assert total == [points[entry == z].sum(0).tolist() for z in range(len(book))]
    for node, (a, e) in enumerate(tree.span):
        own = points[tree.order[a:e]]
        assert (tree.low[node] == own.min(0)).all() and (tree.high[node] == own.max(0)).all() and (tree.total[node] == own.sum(0)).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op12_codes(spark, sf).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)
