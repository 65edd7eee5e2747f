"""Strongly connected components, cycles inside them, and reachability of asked pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .elimination import LEVEL, held, solve
from .scratch import Scratch

#: Links that a task contracts at a time.
PIECE = 1 << 18


def _without(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links that neither start nor end at a node of ``gone(node)``."""
    left = links.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    return left.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def _trimmed(s: Scratch, links: DataFrame, rounds: int = 4) -> DataFrame:
    """Links without those that no cycle can pass. Short tails go node by node in a few rounds; if there are
    longer ones, what is not above a cycle goes by elimination, and then what is not below one."""
    n = links.count()
    for _ in range(rounds):
        starts, ends = links.select(F.col("src").alias("dst")), links.select(F.col("dst").alias("src"))
        links = s.cut(links.join(ends.distinct(), "src", "left_semi").join(starts.distinct(), "dst", "left_semi").select("src", "dst"))
        if (now := links.count()) in (0, n):
            return links
        n = now
    links = s.cut(_without(links, solve(links, {"level": LEVEL})))
    if not links.take(1):
        return links
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return s.cut(_without(links, solve(turned, {"level": LEVEL})))


def _coloured(s: Scratch, links: DataFrame) -> DataFrame:
    """id, c: nodes with an equal colour are a component; nodes that are one by themselves may be missing.

    Each node takes the largest id that reaches it; the nodes of a colour that reach the node which
    gave it are a component. These go, and what is left is treated alike."""
    out = None
    while links.take(1):
        colours = s.cut(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            step = links.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("d"))
            now = s.cut(colours.join(step, "id", "left").select("id", F.greatest("c", "d").alias("n"), "c"))
            colours = now.select("id", F.col("n").alias("c"))
            if not now.filter("n <> c").take(1):
                break
        same = s.cut(links.join(colours.select(F.col("id").alias("src"), "c"), "src").join(colours.select(F.col("id").alias("dst"), "c"), ["dst", "c"]))
        found = front = s.cut(colours.filter("id = c"))
        while front.take(1):
            back = same.join(front.withColumnRenamed("id", "dst"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            front = s.cut(back.join(found, ["id", "c"], "left_anti"))
            found = found.unionByName(front)
        found = s.cut(found)
        out = found if out is None else out.unionByName(found)
        links = _without(links, found.select(F.col("id").alias("node")))
        links = _trimmed(s, links)
    return out


def _wide(s: Scratch, core: DataFrame) -> DataFrame:
    """id, component of the nodes of ``core``, which has no end outside cycles; some that are one by themselves may be missing.

    Stretches of nodes with one way in and one out are contracted by pointer doubling: they are in a component if
    their ends are in one. The rest is coloured."""
    out, into = core.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.max("dst").alias("to")), core.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    jump = s.cut(out.join(into, "id").filter("n_out = 1 and n_in = 1").select("id", "to", F.col("id").alias("last"), F.col("id").alias("low")))
    steps, most = 0, jump.count().bit_length()
    while steps <= most and jump.join(jump.select(F.col("id").alias("to")), "to", "left_semi").take(1):
        then = jump.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("last").alias("end"), F.col("low").alias("under"))
        jump = s.cut(jump.join(then, "to", "left").select("id", F.coalesce("then", "to").alias("to"), F.coalesce("end", "last").alias("last"), F.least("low", "under").alias("low")))
        steps += 1
    ring = jump.join(jump.select(F.col("id").alias("to")), "to", "left_semi").select("id", F.col("low").alias("component"))  # rings of such nodes alone
    settled = s.cut(jump.join(jump.select(F.col("id").alias("to")), "to", "left_anti").select("id", "to", "last"))
    heads = core.join(jump.select(F.col("id").alias("src")), "src", "left_anti")
    turned = s.cut(heads.join(settled.select(F.col("id").alias("dst"), "to", "last"), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"), "last"))
    found = _coloured(s, s.cut(turned.filter("src <> dst").select("src", "dst").distinct()))
    if found is None:  # only stretches that return to where they start
        found = turned.select(F.col("src").alias("id"), F.col("src").alias("c")).distinct()
    at = lambda name, c: found.select(F.col("id").alias(name), F.col("c").alias(c))
    ends = turned.filter("last is not null").join(at("src", "c_src"), "src", "left").join(at("dst", "c_dst"), "dst", "left")
    closed = ends.filter((F.col("src") == F.col("dst")) | (F.col("c_src") == F.col("c_dst"))).select("last", F.coalesce("c_src", "src").alias("c"))
    inner = settled.join(closed, "last").select("id", "c")
    own = turned.select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti").withColumn("c", F.col("id"))
    labels = s.cut(found.unionByName(own).unionByName(inner))
    least = labels.groupBy("c").agg(F.min("id").alias("component"))
    return labels.join(least, "c").select("id", "component").unionByName(ring)

def components(edges: DataFrame, vertices: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """id, component (its smallest id) of every node of ``edges(src, dst)`` and ``vertices(id)``.

    First each task contracts the components of its own links, as they lie, ``piece`` at a time. Links that lie near
    those they make cycles with, such as one customer's after a window by customer, leave little for the joins; in any
    other order the result is the same. A node that pieces contract to different nodes is linked with these both ways. Of the
    links between contracted nodes, those that are not both above and below a cycle go. A rest of one
    piece is one more such piece; a larger one takes rounds of joins. ``piece`` 0: joins alone, as for ids that
    are neither whole numbers nor plain strings."""
    s = Scratch(edges.sparkSession)
    if piece and pieces.fits(edges):
        rows = s.cut(pieces.contracted(edges, piece))
        inside = rows.filter("inside")
        every = s.cut(inside.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low"), F.max("dst").alias("high")))
        seams = inside.filter("src <> dst").join(every.filter("low <> high").select(F.col("id").alias("src")), "src", "left_semi")
        links = rows.filter("not inside").select("src", "dst").unionByName(seams.select("src", "dst")).unionByName(seams.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).filter("id is not null").distinct()
        every, links, piece = s.cut(ids.withColumn("low", F.col("id"))), edges.select("src", "dst").filter("src <> dst"), 0
    if vertices is not None:
        more = vertices.select("id", F.col("id").alias("low")).filter("id is not null")
        every = s.cut(every.select("id", "low").unionByName(more).groupBy("id").agg(F.min("low").alias("low")))
    links = s.cut(links.distinct())
    n = links.count()
    if n > piece:
        links = _trimmed(s, links)
        n = links.count()
    if not n:
        return s.result(every.select("id", F.col("low").alias("component")))
    if n <= piece:
        labels = s.cut(pieces.contracted(links.coalesce(1), piece + 1)).filter("inside").select(F.col("src").alias("id"), F.col("dst").alias("component"))
    else:
        labels = _wide(s, links)
    labels = labels.select(F.col("id").alias("low"), "component").filter("low <> component")
    return s.result(every.join(labels, "low", "left").select("id", F.coalesce("component", "low").alias("component")))


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """cycle: each elementary cycle once, from its smallest node on, closed by it again; only those
    of up to ``max_length`` nodes if that is given.

    Paths only pass links inside a component, nodes above their start, and nodes from which the
    start is reached over such nodes; a path that can't be closed is not grown. So a graph without cycles has no path at all."""
    s = Scratch(edges.sparkSession)
    links = s.cut(edges.select("src", "dst").distinct())
    found = links.filter("src = dst").select(F.array("src", "dst").alias("cycle"))
    labels = components(links)
    at = lambda name: labels.select(F.col("id").alias(name), "component")
    links = s.cut(links.filter("src <> dst").join(at("src"), "src").join(at("dst"), ["dst", "component"]).select("src", "dst"))
    back = front = s.cut(links.filter("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("id")))
    while front.take(1):
        step = front.join(links.withColumnRenamed("dst", "id"), "id").filter("src > start").select("start", F.col("src").alias("id")).distinct()
        front = s.cut(step.join(back, ["start", "id"], "left_anti"))
        back = back.unionByName(front)
    back = s.cut(back)
    paths = links.join(back.select(F.col("start").alias("src"), F.col("id").alias("dst")), ["src", "dst"], "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("id"), F.array("src", "dst").alias("path"))
    n = 2
    while (max_length is None or n <= max_length) and (paths := s.cut(paths)).take(1):
        step = paths.join(links.withColumnRenamed("src", "id"), "id")
        found = found.unionByName(step.filter("dst = start").select(F.concat("path", F.array("dst")).alias("cycle")))
        step = step.filter((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        paths = step.join(back, ["start", "id"], "left_semi")
        n += 1
    return s.result(found)


def reaches(edges: DataFrame, pairs: DataFrame, n_words: int = 4) -> DataFrame:
    """src, dst, reached of each of ``pairs(src, dst)``: whether a way leads from src to dst. A node is
    not its own dependency, even on a cycle; unknown or null nodes reach nothing.

    Nodes are labelled once: with their level, and with a Bloom filter of ``n_words`` words of all that they
    reach; where there are cycles, their components become nodes first. Pairs that are links need no search, and a
    pair is refused if its labels forbid a way. For the others a search goes down from src, only over nodes whose
    labels allow a way to dst; rows grow with the pairs asked, not with all pairs."""
    s = Scratch(edges.sparkSession)
    words = [f"held{k}" for k in range(n_words)]
    fields = {"level": LEVEL} | {x: held(k, n_words) for k, x in enumerate(words)}
    asked = s.cut(pairs.select("src", "dst").distinct()).withColumns({"a": F.col("src"), "b": F.col("dst")})
    links = s.cut(edges.select("src", "dst").filter("src <> dst").distinct())
    marks = solve(links, fields)
    rest = s.cut(links.join(marks.select(F.col("node").alias("src")), "src", "left_anti"))
    if rest.take(1):  # on or above a cycle
        labels = components(rest).filter("id <> component")
        at = lambda name: labels.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))
        mapped = lambda df: df.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select("src", "dst", F.coalesce("c_src", "src").alias("a"), F.coalesce("c_dst", "dst").alias("b"))
        nodes = links.select(F.explode(F.array("src", "dst")).alias("id")).join(labels, "id", "left").select(F.coalesce("component", "id").alias("id")).distinct()
        asked = s.cut(mapped(asked.select("src", "dst")))
        links = s.cut(mapped(links).filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        marks = solve(links, fields, nodes)

    def allowed(rows: DataFrame, node: str) -> DataFrame:
        """``rows`` whose labels allow a way from ``node`` to b."""
        own = marks.select(F.col("node").alias(node), F.col("level").alias("l"), *(F.col(x).alias(f"n{x}") for x in words))
        ok = F.col("l") > F.col("level")
        for x in words:
            ok = ok & (F.col(x).bitwiseAND(F.bitwise_not(F.col(f"n{x}"))) == 0)
        return rows.join(own, node).filter(ok).drop("l", *(f"n{x}" for x in words))

    # most pairs are settled by a look at the links, or by b's own bit, which needs no label of b
    direct = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("linked"))
    asked = s.cut(asked.join(direct, ["a", "b"], "left"))
    open_ = asked.filter("a <> b and linked is null").select("a", "b")
    bit = F.lit(True)
    for k, x in enumerate(words):
        own = held(k, n_words).leaf(F.col("b"))
        bit = bit & (own.bitwiseAND(F.bitwise_not(F.col(x))) == 0)
    likely = s.cut(open_.join(marks.select(F.col("node").alias("a"), *words), "a").filter(bit).select("a", "b").distinct())
    front = s.cut(allowed(likely.join(marks.withColumnRenamed("node", "b"), "b"), "a").withColumn("at", F.col("a")))
    seen, hit = front.select("a", "b", "at"), None
    while front.take(1):
        step = s.cut(front.join(links.withColumnRenamed("src", "at"), "at").drop("at").withColumnRenamed("dst", "at").distinct())
        new = step.filter("at = b").select("a", "b")
        hit = s.cut(new if hit is None else hit.unionByName(new)).distinct()
        further = allowed(step.filter("at <> b"), "at").join(hit, ["a", "b"], "left_anti")
        front = s.cut(further.join(seen, ["a", "b", "at"], "left_anti"))
        seen = seen.unionByName(front.select("a", "b", "at"))
    if hit is None:
        hit = asked.select("a", "b").limit(0)
    within = (F.col("a") == F.col("b")) & (F.col("src") != F.col("dst"))
    out = asked.join(hit.withColumn("hit", F.lit(True)), ["a", "b"], "left")
    return s.result(out.select("src", "dst", (F.coalesce(within, F.lit(False)) | F.coalesce("linked", F.lit(False)) | F.coalesce("hit", F.lit(False))).alias("reached")))
