"""Components, cycles, levels, reachability and chains against plain searches."""

import random
import time

from pyspark.sql import functions as F

from codelake.operators import chains, components, elimination, graph

LINKS = "src int, dst int"


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), LINKS)


def closure(edges):
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    nodes = {x for e in edges for x in e}
    out = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in below.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


def shifted(graphs):
    """Several graphs side by side, as one."""
    return {(1000 * k + a, 1000 * k + b) for k, edges in enumerate(graphs) for a, b in edges}


def graphs():
    rng = random.Random(3)
    yield {(0, 0), (0, 1)}
    yield {(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 2), (5, 0), (4, 6), (7, 8), (8, 7), (8, 9), (9, 8)}
    yield {(i, (i + 1) % 30) for i in range(30)} | {(40 + i, 41 + i) for i in range(9)} | {(3, 40), (49, 5)} | {(100, 7), (8, 101)}
    for n, m in ((14, 16), (25, 32), (9, 30), (40, 50), (12, 18)):
        yield {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def test_random_graphs(spark):
    edges = shifted(graphs())
    reach = closure(edges)
    df = frame(spark, edges)
    want = {n: min([m for m in reach[n] if n in reach[m]] + [n]) for n in reach}
    assert {r["id"]: r["component"] for r in components.components(df).collect()} == want
    assert sorted(r["id"] for r in graph.cycle_members(df).collect()) == sorted(n for n in reach if n in reach[n])
    level = {}
    free = [n for n in reach if not any(m in reach[m] for m in reach[n] | {n})]
    for n in sorted(free, key=lambda n: len(reach[n])):
        level[n] = max((level[b] + 1 for a, b in edges if a == n), default=0)
    assert {r["node"]: r["level"] for r in graph.topological_levels(df).collect()} == level
    ways = {}
    for n in sorted(free, key=level.get):
        ways[n] = sum(ways[b] for a, b in edges if a == n) or 1
    assert {r["node"]: int(r["n"]) for r in chains.chain_counts(df).collect()} == ways
    nodes = [*reach, 999, None]
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes if None in (a, b) or a // 1000 == b // 1000], LINKS)
    got = {(r["src"], r["dst"]) for r in components.reaches(df, pairs).collect() if r["reached"]}
    assert got == {(a, b) for a in reach for b in reach[a] if a != b}


def test_cycles_against_search(spark):
    rng = random.Random(5)
    edges = shifted([{(rng.randrange(n), rng.randrange(n)) for _ in range(m)} for n, m in ((7, 20), (12, 24), (5, 9))])
    want = []

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    want.append([*path, b])
                elif b > path[0] and b not in path:
                    walk([*path, b])

    for start in {a for a, _ in edges}:
        walk([start])
    got = graph.cycles(frame(spark, edges)).collect()
    assert sorted(r["cycle"] for r in got) == sorted(want)
    assert sorted(r["cycle"] for r in graph.cycles(frame(spark, edges), 3).collect()) == sorted(c for c in want if len(c) <= 4)


def test_layered_graph_without_cycles(spark):
    """10 layers of 1,000 nodes, 10^5 links: paths would be 10^10; no path is made."""
    df = spark.range(100_000).select((F.expr("id div 10")).cast("int").alias("src"), (1000 * (1 + F.expr("id div 10000")) + F.pmod(F.xxhash64("id"), F.lit(1000))).cast("int").alias("dst"))
    start = time.time()
    assert graph.cycles(df).count() == 0
    assert time.time() - start < 60
    assert graph.topological_levels(df).agg(F.max("level")).first()[0] == 10


def test_long_chain_takes_few_rounds(spark):
    df = spark.range(10_000).select(F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"))
    rounds = []
    out = elimination.solve(df, {"level": elimination.LEVEL}, rounds=rounds)
    assert out.filter("level = 10000 - node").count() == 10_001
    assert len(rounds) + sum(rounds) < 20
    ring = df.unionByName(spark.createDataFrame([(10_000, 0)], LINKS))
    assert components.components(ring).filter("component = 0").count() == 10_001


def test_chains_too_many_to_list(spark):
    """100 diamonds in a row: 2^100 chains, counted exactly and drawn by rank."""
    edges = {(3 * k, 3 * k + j) for k in range(100) for j in (1, 2)} | {(3 * k + j, 3 * k + 3) for k in range(100) for j in (1, 2)}
    df = frame(spark, edges)
    assert {r["node"]: int(r["n"]) for r in chains.chain_counts(df).collect()}[0] == 2**100
    short = chains.chains_at(df.filter("src < 30"), spark.createDataFrame([(0, 0), (0, 5), (0, 1023), (0, 1024), (0, -1)], "start int, rank long")).collect()
    assert sorted(r["rank"] for r in short) == [0, 5, 1023]
    for r in short:
        rank = r["rank"]
        assert r["chain"][1::2] == [3 * k + 1 + (rank >> (9 - k) & 1) for k in range(10)]


def test_pages_are_the_list(spark):
    edges = {(a, b) for a in range(6) for b in range(a + 1, 6)} | {(6, 6), (6, 0)}
    df = frame(spark, edges)
    every = sorted(r["chain"] for r in graph.call_chains(df, 0).collect())
    paged = [r for p in (0, 9) for r in chains.chain_page(df, 0, p, 9).collect()]
    assert [r["chain"] for r in sorted(paged, key=lambda r: r["rank"])] == every and len(every) == 16
    assert chains.chain_page(df, 6, 0, 5).count() == 0
    assert chains.chain_counts(spark.createDataFrame([], LINKS)).count() == 0
    assert components.components(spark.createDataFrame([], LINKS)).count() == 0


def test_adjacency_blocks(spark):
    """A hub of 300,000 links in rows of bounded length, both directions, against sets."""
    hub = spark.range(300_000).select(F.lit(-1).cast("long").alias("src"), "id")
    few = [(-2, 5), (-2, 5), (-2, 7), (3, -2), (None, 1), (4, None), (9, 9)]
    edges = hub.toDF("src", "dst").unionByName(spark.createDataFrame(few, "src long, dst long"))
    out = graph.adjacency(edges, 1000)
    assert out.agg(F.max("n"), F.max(F.size("neighbours"))).first()[:] == (1000, 1000)
    own = out.filter("id = -1").orderBy("block").collect()
    assert [r["block"] for r in own] == list(range(len(own))) and 300 <= len(own) <= 301
    assert [x for r in own for x in r["neighbours"]] == list(range(300_000))
    assert all((r["first"], r["last"], r["n"]) == (r["neighbours"][0], r["neighbours"][-1], len(r["neighbours"])) for r in own)
    rest = {(r["id"], r["direction"]): r["neighbours"] for r in out.filter("id in (-2, 9) or (id = 5 and direction = 'in')").collect()}
    assert rest == {(-2, "out"): [5, 7], (-2, "in"): [3], (9, "out"): [9], (9, "in"): [-1, 9], (5, "in"): [-2, -1]}
    assert graph.adjacency(edges.limit(0)).count() == 0
    text = graph.export_blocks(out).filter("id = 5").first()["json"]
    assert text == '{"id":5,"direction":"in","block":0,"neighbours":[-2,-1]}'


def test_stretches_to_settled_nodes_take_one_round(spark):
    """A link to the one before and to the first: after one step all nodes have one link, and one doubling settles them."""
    df = frame(spark, {(100 * g + i, 100 * g + j) for g in range(30) for i in range(1, 20) for j in (0, i - 1)})
    rounds = []
    out = elimination.solve(df, {"level": elimination.LEVEL, "n": elimination.WAYS}, rounds=rounds)
    assert {(r["node"], r["level"], int(r["n"])) for r in out.collect()} == {(100 * g + i, i, max(1, i)) for g in range(30) for i in range(20)}
    assert len(rounds) == 1 and sum(rounds) <= 6
