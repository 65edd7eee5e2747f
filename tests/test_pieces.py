"""Components by pieces of the links, in any layout, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import components, pieces, scratch

from .test_graphs import closure, graphs, shifted


def want(edges):
    reach = closure(edges)
    return {n: min([m for m in reach[n] if n in reach[m]] + [n]) for n in reach}


def dense():
    """Pieces of these hold components of their own, and share nodes."""
    rng = random.Random(8)
    return [{(rng.randrange(n), rng.randrange(n)) for _ in range(m)} for n, m in ((12, 60), (20, 50), (6, 30))]


def test_least_against_search():
    import numpy as np

    for edges in [*graphs(), *dense()]:
        n = 1 + max(max(e) for e in edges)
        src, dst = np.array(sorted(edges)).T
        got = pieces.least(n, src, dst).tolist()
        assert {v: got[v] for v in want(edges)} == want(edges)
    ring = np.arange(50_000)
    assert not pieces.least(50_000, ring, (ring + 1) % 50_000).any()
    assert len(pieces.least(0, ring[:0], ring[:0])) == 0


@pytest.mark.parametrize("piece,parts", [(0, 3), (1, 1), (1, 7), (40, 5), (1000, 3)])
def test_any_layout(spark, piece, parts):
    edges = shifted([*graphs(), *dense()])
    df = spark.createDataFrame([*edges, *list(edges)[:50], (None, 1), (77_000, None), (None, None)], "src int, dst int").repartition(parts, F.rand(1))
    nodes = spark.createDataFrame([(0,), (88_000,), (88_000,), (None,), (1001,)], "id int")
    got = components.components(df, nodes, piece).collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: r["component"] for r in got} == want(edges) | {77_000: 77_000, 88_000: 88_000}


def test_names_are_ordered_by_bytes(spark):
    rows = [("é", "z"), ("z", "é"), ("\U0001f642", "￮"), ("￮", "\U0001f642"), ("", "a"), ("a", "B"), ("B", "a")]
    for piece in (0, 1, 100):
        got = components.components(spark.createDataFrame(rows, "src string, dst string"), piece=piece).collect()
        assert {r["id"]: r["component"] for r in got} == {"é": "z", "z": "z", "\U0001f642": "￮", "￮": "￮", "": "", "a": "B", "B": "B"}


def test_links_that_lie_together_take_few_rounds(spark, monkeypatch):
    """300 walks over five nodes each, as they come from a window: no loop of joins."""
    cuts, cut = [], scratch.Scratch.cut
    monkeypatch.setattr(scratch.Scratch, "cut", lambda self, df: cuts.append(1) or cut(self, df))
    rng = random.Random(2)
    walks = [[5 * k + rng.randrange(5) for _ in range(10)] for k in range(300)]
    df = spark.createDataFrame([e for w in walks for e in zip(w, w[1:])], "src int, dst int")
    got = {r["id"]: r["component"] for r in components.components(df).collect()}
    assert got == want({e for w in walks for e in zip(w, w[1:])})
    assert len(cuts) <= 5
