"""Recurrences over the links of a graph, solved by elimination.

A node's value is ``own + sum of (weight x value)`` over what it depends on, in any semiring: levels are
(max, +), numbers of chains (sum, x), filters of all that a node reaches (or). Each round settles the nodes that depend on
nothing open, and then eliminates all nodes with one open link: their links are followed by pointer
doubling, composed in the semiring, so a stretch of n such nodes takes log2(n) joins; those that end at a
settled node are settled by the same joins. Chains and trees take a few rounds, other graphs at most one for
each level of nodes that branch. No table has more rows than links. Nodes carry the number of their open links, so
what is settled or has one link is a filter, not a join; the joins of a doubling take only rows that still move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Semiring:
    unit: Callable[[], Column] | None  # weight of a link; None if weights change nothing
    leaf: Callable[[Column], Column]  # value of a node without links, by its id
    inner: Callable[[Column], Column]  # own part of any other node
    total: Callable[[Column], Column]  # aggregate
    plus: Callable[[Column, Column], Column]
    times: Callable[[Column, Column], Column]


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _exact(n: int) -> Column:
    return F.lit(n).cast("decimal(38,0)")


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


#: Links on the longest way down.
LEVEL = Semiring(lambda: _long(1), lambda n: _long(0), lambda n: _long(0), F.max, F.greatest, lambda w, x: w + x)
#: Ways down to a node without links. Beyond 38 digits the sum fails, it does not wrap.
WAYS = Semiring(lambda: _exact(1), lambda n: _exact(1), lambda n: _exact(0), lambda c: _whole(F.sum(c)), lambda a, b: _whole(a + b), lambda w, x: _whole(w * x))


def held(k: int, words: int) -> Semiring:
    """Word ``k`` of a Bloom filter of a node and all below it."""

    def own(n: Column) -> Column:
        h = F.xxhash64(n)
        bit = F.call_function("shiftleft", _long(1), h.bitwiseAND(63).cast("int"))
        return F.when(F.pmod(F.shiftright(h, 6), F.lit(words)) == k, bit).otherwise(_long(0))

    return Semiring(None, own, own, F.bit_or, lambda a, b: a.bitwiseOR(b), lambda w, x: x)


def solve(links: DataFrame, fields: dict[str, Semiring], vertices: DataFrame | None = None, rounds: list | None = None) -> DataFrame:
    """node and a column for each field, of all nodes of ``links(src, dst)`` and ``vertices(id)``
    that are neither on a cycle nor above one. ``rounds`` is given the number of joins of each round's doubling."""
    s = Scratch(links.sparkSession)
    names = list(fields)
    weights = [f"w_{n}" for n, f in fields.items() if f.unit is not None]
    values = [f"b_{n}" for n in names]
    weight = lambda n, p="w": F.col(f"{p}_{n}") if fields[n].unit is not None else F.lit(None)
    links = links.select("src", "dst").filter("src is not null and dst is not null").distinct()
    links = s.cut(links.withColumns({f"w_{n}": f.unit() for n, f in fields.items() if f.unit is not None}))
    nodes = links.select(F.col("src").alias("node"), F.lit(1).cast("long").alias("k")).unionByName(links.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("k")))
    if vertices is not None:
        nodes = nodes.unionByName(vertices.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("k")))
    nodes = nodes.groupBy("node").agg(F.sum("k").alias("k"))
    nodes = s.cut(nodes.select("node", "k", *(F.when(F.col("k") > 0, f.inner(F.col("node"))).otherwise(f.leaf(F.col("node"))).alias(f"b_{n}") for n, f in fields.items())))
    ready = nodes.filter("k = 0").select("node", *values)
    known, eliminated = [ready], []
    while ready.take(1):
        # what is settled is taken into the nodes above it
        seen = links.join(ready.select(F.col("node").alias("dst"), F.lit(True).alias("hit"), *(F.col(f"b_{n}").alias(f"c_{n}") for n in names)), "dst", "left")
        seen = s.cut(seen.select("src", F.when(F.col("hit").isNull(), F.col("dst")).alias("dst"), *weights, *(F.when(F.col("hit"), f.times(weight(n), F.col(f"c_{n}"))).alias(f"g_{n}") for n, f in fields.items())))
        met = F.col("dst").isNull()
        sums = seen.groupBy(F.col("src").alias("node")).agg(F.count_if(met).alias("n"), F.max("dst").alias("to"), *(F.max(F.when(~met, F.col(w))).alias(w) for w in weights), *(f.total(F.col(f"g_{n}")).alias(f"g_{n}") for n, f in fields.items()))
        more = [F.when(F.coalesce("n", F.lit(0)) > 0, f.plus(F.col(f"b_{n}"), F.col(f"g_{n}"))).otherwise(F.col(f"b_{n}")).alias(f"b_{n}") for n, f in fields.items()]
        left = F.col("k") - F.coalesce("n", F.lit(0))
        nodes = s.cut(nodes.filter("k > 0").join(sums, "node", "left").select("node", left.alias("k"), *(F.when(left == 1, F.col(c)).alias(c) for c in ("to", *weights)), *more))
        n_of = nodes.agg(*(F.count_if(c).alias(x) for x, c in (("none", F.col("k") == 0), ("one", F.col("k") == 1), ("more", F.col("k") > 1)))).first()
        if rounds is not None:
            rounds.append(0)
        ready = nodes.filter("k = 0").select("node", *values)
        known.append(ready)
        links = seen.filter("dst is not null").select("src", "dst", *weights)
        if not n_of["one"]:
            nodes = nodes.filter("k > 1").select("node", "k", *values)
            continue
        # rows without ``to`` have their value; ``moves`` says that the next join may change a row
        jump = nodes.filter("k <= 1").select("node", "to", F.col("to").isNotNull().alias("moves"), *weights, *values)
        target = lambda df: df.select(F.col("node").alias("to"), F.lit(True).alias("there"), F.col("to").alias("then"), F.col("moves").alias("on"), *(F.col(w).alias(f"v_{w[2:]}") for w in weights), *(F.col(f"b_{n}").alias(f"c_{n}") for n in names))
        joins, most = 0, (n_of["one"] + n_of["none"]).bit_length() + 1
        moving, still = jump.filter("moves"), jump.filter("not moves")
        while joins <= most and moving.take(1):
            far = moving.join(target(jump), "to", "left")
            there = F.col("there").isNotNull()
            out = [F.when(there, F.col("then")).otherwise(F.col("to")).alias("to"), F.coalesce("on", F.lit(False)).alias("moves")]
            out += [F.when(there & F.col("then").isNotNull(), fields[w[2:]].times(F.col(w), F.col(f"v_{w[2:]}"))).otherwise(F.col(w)).alias(w) for w in weights]
            out += [F.when(there, f.plus(F.col(f"b_{n}"), f.times(weight(n), F.col(f"c_{n}")))).otherwise(F.col(f"b_{n}")).alias(f"b_{n}") for n, f in fields.items()]
            moved = s.cut(far.select("node", *out).select("node", "to", "moves", *weights, *values))
            still = still.unionByName(moved.filter("not moves"))
            moving = moved.filter("moves")
            jump = still.unionByName(moving)
            joins += 1
        if rounds is not None:
            rounds[-1] = joins
        # what moves by now is a ring, or leads into one
        solved = still.filter("to is null").select("node", *values)
        known[-1] = solved  # with those that were ready
        ready = solved
        if not n_of["more"]:
            break
        ends = s.cut(still.filter("to is not null").select("node", "to", *weights, *values))
        eliminated.append((len(known), ends))
        # links of nodes with several: past eliminated nodes, which give their value on the way; those to settled nodes are met in the next round
        gone = ends.select(F.col("node").alias("dst"), F.col("to").alias("then"), *(F.col(w).alias(f"v_{w[2:]}") for w in weights), *(F.col(f"b_{n}").alias(f"c_{n}") for n in names))
        rest = links.join(nodes.filter("k > 1").select(F.col("node").alias("src")), "src", "left_semi").join(gone, "dst", "left")
        go = F.col("then").isNotNull()
        turned = rest.select("src", F.coalesce("then", "dst").alias("dst"), go.alias("go"), *(F.when(go, fields[w[2:]].times(F.col(w), F.col(f"v_{w[2:]}"))).otherwise(F.col(w)).alias(w) for w in weights), *(F.when(go, f.times(weight(n), F.col(f"c_{n}"))).alias(f"g_{n}") for n, f in fields.items()))
        turned = s.cut(turned.groupBy("src", "dst").agg(F.count_if("go").alias("n"), *(fields[w[2:]].total(F.col(w)).alias(w) for w in weights), *(f.total(F.col(f"g_{n}")).alias(f"g_{n}") for n, f in fields.items())))
        links = turned.select("src", "dst", *weights)
        sums = turned.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("left"), F.sum("n").alias("n"), *(f.total(F.col(f"g_{n}")).alias(f"g_{n}") for n, f in fields.items()))
        more = [F.when(F.col("n") > 0, f.plus(F.col(f"b_{n}"), F.col(f"g_{n}"))).otherwise(F.col(f"b_{n}")).alias(f"b_{n}") for n, f in fields.items()]
        nodes = s.cut(nodes.filter("k > 1").select("node", *values).join(sums, "node").select("node", F.col("left").alias("k"), *more))
    out = None
    while known or eliminated:
        # eliminated rows lead to nodes that were settled in a later round
        if eliminated and eliminated[-1][0] == len(known):
            jump = eliminated.pop()[1]
            if out is None:
                continue
            found = jump.join(out.select(F.col("node").alias("to"), *names), "to")
            out = out.unionByName(found.select("node", *(f.plus(F.col(f"b_{n}"), f.times(weight(n), F.col(n))).alias(n) for n, f in fields.items())))
            out = s.cut(out) if len(eliminated) > 1 else out
        else:
            rows = known.pop().select("node", *(F.col(f"b_{n}").alias(n) for n in names))
            out = rows if out is None else out.unionByName(rows)
    return s.result(out)
