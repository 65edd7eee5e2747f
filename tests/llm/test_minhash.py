import random
from collections import defaultdict

import numpy as np

from codelake.llm import minhash
from codelake.llm.graphs import components
from codelake.llm.queries import op8_near_dedup


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        if d is not None:
            for x in s:
                index[x].append(k)
    seen = set()
    for held in index.values():
        for i in held:
            for j in held:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        x, y = sorted((top(sets[i][0]), top(sets[j][0])))
                        parent[y] = x
    return sorted(((d, len(s), d if d is None else top(d) if s else d, d is None or (not s) or top(d) == d) for d, s in sets), key=str)


def run(df):
    return sorted(map(tuple, minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def family(rng, vocabulary, base, copies, edits, first):
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((first + k, " ".join(w)))
    return out


def test_families_and_shared_passages(spark, vocabulary):
    rng = random.Random(11)
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, passage = [], text(60)
    for k in range(6):
        docs += family(rng, vocabulary, text(120), 25, 9, 1000 * k)
    docs += family(rng, vocabulary, text(900), 6, 15, 7000)
    docs += [(8000 + k, " ".join(text(90) + passage + text(40))) for k in range(120)]
    docs += [(9000 + k, " ".join(passage)) for k in range(20)]
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)) == brute(docs)


def test_chain_of_copies(spark, vocabulary):
    """Neighbours are alike, the ends are not; all are one component."""
    rng = random.Random(5)
    w = [rng.choice(vocabulary) for _ in range(200)]
    docs = []
    for k in range(60):
        docs.append((100 - k, " ".join(w)))
        at = (k * 3) % 195
        w[at : at + 2] = [rng.choice(vocabulary) for _ in range(2)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute(docs) and len({r[2] for r in got}) == 1


def test_large_family_in_blocks(spark, vocabulary):
    """Over 256 members that are not all alike: several blocks, isolated members among them."""
    rng = random.Random(8)
    docs = family(rng, vocabulary, [rng.choice(vocabulary) for _ in range(100)], 700, 14, 0)
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)


def test_odd_rows(spark, odd, none, clashing):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(clashing(odd)) == brute(docs)
    assert run(none) == []


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, op8_near_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(docs)


def test_repeated_ids(spark, vocabulary):
    """One doc_id with several texts is one document: it joins the groups of all its texts."""
    rng = random.Random(21)
    a, b, c = ([rng.choice(vocabulary) for _ in range(60)] for _ in range(3))
    docs = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x", "y"])), (9, " ".join([*b, "x", "y"])), (9, " ".join([*b, "x", "y"])), (11, " ".join(c)), (12, ""), (12, " ".join([*c, "z"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(df) == brute(docs)
    assert {r[0]: r[2] for r in run(df)}[9] == 5
    kept = sorted((r["doc_id"], r["t"]) for r in minhash.representatives(df).collect())
    hashes = {(r["doc_id"], r["text"]): r["t"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) as t").collect()}
    assert kept == sorted((d, hashes[d, t]) for d, t in (docs[0], docs[1], docs[5], docs[6]))


def test_links_of_the_test_table_are_all_found(spark):
    """No pair of texts of similarity 0.75 or more of a whole test table lies in two components."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op8_near_dedup(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(docs)


def test_bitmap_never_rules_out_a_link():
    rng = np.random.default_rng(2)
    sets = []
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for n in (10, 100, 1000, 1500):
        sets += [np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, max(1, n // k), dtype=np.uint64)])) for k in (5, 8, 20)]
    bits = [minhash.bitmap(s) for s in sets]
    n = np.array([len(s) for s in sets])
    for i in range(len(sets)):
        for j in range(len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            alike = 100 * common >= 75 * (n[i] + n[j] - common)
            may = minhash._possible(bits, n, np.array([i]), np.array([j]), 75)[0]
            assert may or not alike


def test_tables_find_similar_sets():
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = s[:350], s[50:]  # similarity 0.75
        x, y = minhash.half_keys(np.unique(a)), minhash.half_keys(np.unique(b))
        met += (x[: minhash.HALVES] == y[: minhash.HALVES]).any() and (x[minhash.HALVES :] == y[minhash.HALVES :]).any()
    assert met >= 297


def test_components_with_hubs(spark):
    """Nodes with most of all links, and hubs that are linked with each other."""
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 500)] + [(1000, i) for i in range(1001, 1600)] + [(1599, 499)] + [(i, 5000) for i in range(2000, 2300)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(c == (0 if n < 1600 else 2000) for n, c in got.items()) and len(got) == 500 + 600 + 301


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 80)] + [(200, 150), (150, 300), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(81)) and got[200] == got[150] == got[300] == 150
