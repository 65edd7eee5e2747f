import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codelake.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOW))) for r in rows]
    groups, held, n = sorted({d[:2] for d in docs}), Counter(), defaultdict(Counter)
    for lang, source, t in docs:
        held.update((lang, x) for x in set(t))
        n[lang, source].update(t)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [x for (at, x), c in held.items() if at == lang and c >= min_docs]
        own = [g for g in groups if g[0] == lang]
        whole = Counter()
        for g in own:
            whole.update(n[g])
        part = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c[y] for y in kept) + 2 * len(kept)) for x in kept}  # noqa: B023, E731
        p, q = {g: part(n[g]) for g in own}, part(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(sum(gap(p[g][x], p[h][x]) for x in kept), h[1]) for h in own if h != g]
            words = [(gap(p[g][x], q[x]), x) for x in kept if n[g][x] and p[g][x] > q[x]]
            for name, found, most in (("pair", pairs, None), ("term", words, top)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(*g, name, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, DOCS), **options).collect()))


def test_against_brute_force(spark):
    import random

    rng, words = random.Random(4), [f"w{chr(97 + i)}" for i in range(26)] + ["Éa", "éa", "東京", "🙂x", "THE", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", None])) for i in range(400)]
    rows += [(900, "only once", "fr", "x"), (901, None, "fr", "y"), (902, "", "fr", None), (903, "1 2 3 _", "it", "z")]
    rows += rows[:30]  # repeated rows are documents of their own
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_docs=1, top=3) == brute(rows, 1, 3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.none() | st.text("aBbÀ \n0é", max_size=12), st.sampled_from([None, "en", "de"]), st.sampled_from([None, "s", "t", "u"])), max_size=25))
def test_any_rows(spark, rows):
    assert run(spark, rows, min_docs=2) == brute(rows, 2)


def test_odd_and_clashing(spark, odd, none, clashing):
    from pyspark.sql import functions as F

    want = sorted(map(tuple, divergence.divergence(odd, min_docs=1).collect()))
    assert want == brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()], 1)
    more = clashing(odd).withColumns({c: F.lit(1) for c in ("n", "p", "q", "t", "d", "docs", "term", "size", "item", "part", "salt", "total")})
    assert sorted(map(tuple, divergence.divergence(more, min_docs=1).collect())) == want
    assert divergence.divergence(none).count() == 0


@pytest.mark.parametrize("n,total,size", [(0, 1, 1), (10**10, 10**11, 5), (9 * 10**17, 10**18, 10**6), (8_999_999_999, 9 * 10**9, 3)])
def test_shares_are_exact(spark, n, total, size):
    df = spark.createDataFrame([(n, total, size)], "n long, total long, size long")
    assert df.select(divergence.share("n", "total", "size")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * size)


def test_no_python_and_early_cut(spark, odd):
    plan = divergence.divergence(odd)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_row_for_each_occurrence(spark, odd):
    """Terms are counted where the texts are read."""
    plan = divergence.term_counts(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("piece", [1, 7, 60, 1 << 24])
def test_counts_do_not_depend_on_pieces(spark, piece):
    from pyspark.sql import functions as F

    texts = ["ab", "Ab cd", "", None, "cd", "é", "É\x7fé", "@ab[cd`e{f~", "x" * 200, "ab\x00ab\tab", " ", "ab ", " ab", "日本 ab日"]
    rows = [(k, x, lang, source) for k, x in enumerate(texts * 3) for lang, source in (("en", "s"), ("en", None), (None, "s"), ("é", "s"))]
    df = spark.createDataFrame(rows, DOCS).repartition(3, F.rand(1))
    n, docs = Counter(), Counter()
    for _, x, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (x or "").translate(LOW))
        n.update((lang or "", source or "", t) for t in found)
        docs.update((lang or "", source or "", t) for t in set(found))
    got = divergence.term_counts(df, piece).collect()
    assert sorted(map(tuple, got)) == sorted((*k, c, docs[k]) for k, c in n.items())


def test_pieces_are_bounded():
    import pyarrow as pa

    texts = [b"x" * k for k in (3, 0, 9, 1, 1, 8, 0, 0, 30, 0, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.binary())], names=["t"]) for a, b in ((0, 4), (4, 4), (4, 9), (9, 11))]
    pieces = [p.column(0).to_pylist() for p in divergence._pieces(batches, 10)]
    assert [x for p in pieces for x in p] == texts and all(pieces)
    assert all(sum(map(len, p)) <= 10 or len(p) == 1 for p in pieces)
    assert len(pieces) <= 6 and list(divergence._pieces([], 10)) == []
