"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors become integers. Equal vectors are one point that keeps its smallest ids, so a vector
that many rows share costs one product. Points are dealt to shards of bounded size by a hash; each
shard's ball tree is built once and written as one row. A node is a centre and a radius, and
``q.c + |q| r`` bounds every product below it.

Queries come in blocks of bounded size, which every task holds; trees are read where they lie, so
neither points nor queries are shuffled for a search. In a tree, each query first descends to the
leaf of the best bounds, which gives it a kth score. All other nodes are then expanded from the
root, those of a bound under the kth score are cut with all that is below them, and the leaves left
are met from the best bound down. The kth score goes on from tree to tree of a task; and a first
job over a sixteenth of the shards gives the score that all tasks of the second one start from.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, shared_dir

LOWEST = -(1 << 63)
TREES = "shard int, dim int, kind string, points binary, ids binary, n_ids binary, span binary, child binary, centre binary, radius binary"
HITS = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * component) as array<bigint>; rows without a usable vector go.

    Products beyond the range of long take its nearest end."""
    clean = F.expr("embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(double(x)) and abs(double(x)) < double('infinity'))")
    return vectors.filter(clean).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


@dataclass
class BallTree:
    """Balls over rows of integer points, which are ordered so that a node is a range of them."""

    points: np.ndarray
    span: np.ndarray  # by node: first row, and one past the last
    child: np.ndarray  # by node: its two children, -1 for a leaf
    centre: np.ndarray
    radius: np.ndarray

    @staticmethod
    def build(points: np.ndarray, leaf: int = 64) -> tuple[BallTree, np.ndarray]:
        """The tree, split at the median along a far pair of points, and the order of its rows."""
        real, order = points.astype(np.float64), np.arange(len(points))
        span, child, centre, radius = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = real[order[lo:hi]]
            middle = own.mean(0)
            away = ((own - middle) ** 2).sum(1)
            node = len(span)
            span.append((lo, hi))
            child.append([-1, -1])
            centre.append(middle)
            radius.append(np.sqrt(away.max()))
            if parent >= 0:
                child[parent][side] = node
            if hi - lo > leaf and away.max() > 0:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                order[lo:hi] = order[lo:hi][np.argsort(own @ (other - far), kind="stable")]
                half = (lo + hi) // 2
                todo += [(lo, half, node, 0), (half, hi, node, 1)]
        return BallTree(points[order], np.array(span), np.array(child), np.array(centre), np.array(radius)), order

    def bounds(self, queries: np.ndarray, length: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of queries[i] with the points of node[i]; rounding is allowed for."""
        size = length * (np.sqrt((self.centre[node] ** 2).sum(1)) + self.radius[node])
        return np.einsum("ij,ij->i", queries, self.centre[node]) + length * self.radius[node] + 1e-9 * size + 1


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer products; those beyond the range of long take its nearest end."""
    most = lambda x: max(int(x.max()), -int(x.min()), 1)
    bound = most(queries) * most(points) * queries.shape[1]
    if bound < 1 << 53:  # every partial sum is exact
        return (queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return queries @ points.T
    whole = queries.astype(object) @ points.T.astype(object)
    return np.clip(whole, LOWEST, (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, id) so far of each query of a block, and the scores that still count."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.query_ids, self.queries, self.kth, self.k = query_ids, queries, floor.copy(), k
        self.real = queries.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(1))
        self.found = np.zeros((3, 0), np.int64)  # query, score, id

    def add(self, tree: BallTree, ids: np.ndarray, first: np.ndarray, leaf: int, own: np.ndarray) -> None:
        """Scores of the queries ``own`` with a leaf's points; equal scores may win by their id."""
        lo, hi = tree.span[leaf]
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            score = products(self.queries[part], tree.points[lo:hi])
            q, p = np.nonzero(score >= self.kth[part][:, None])
            n = first[lo + p + 1] - first[lo + p]
            each = np.repeat(first[lo + p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q, s, x = np.repeat(part[q], n), np.repeat(score[q, p], n), ids[each]
            other = x != self.query_ids[q]
            found = np.concatenate([self.found, [q[other], s[other], x[other]]], axis=1)
            self._keep(found)

    def _keep(self, found: np.ndarray) -> None:
        """The k best ids of each query, each with its best score; the kth counts distinct ids."""
        found = found[:, np.lexsort((~found[1], found[2], found[0]))]
        new = (np.diff(found[0], prepend=-1) != 0) | (np.diff(found[2], prepend=0) != 0)
        new[:1] = True
        found = found[:, new]
        found = found[:, np.lexsort((found[2], ~found[1], found[0]))]  # ~s falls as s rises, without overflow
        start = np.flatnonzero(np.diff(found[0], prepend=-1))
        nth = np.arange(found.shape[1]) - np.repeat(start, np.diff(np.append(start, found.shape[1])))
        last = found[:, nth == self.k - 1]
        self.kth[last[0]] = np.maximum(self.kth[last[0]], last[1])
        self.found = found[:, nth < self.k]

    def search(self, tree: BallTree, ids: np.ndarray, first: np.ndarray, turns: int = 3) -> int:
        """Branch and bound over one tree; returns the number of (query, leaf) pairs that were scored.

        ids[first[i]:first[i + 1]] are the smallest ids (k + 1 at most, ascending) of point i."""
        every = np.arange(len(self.queries))
        node = np.zeros(len(every), np.int64)
        while (inner := tree.child[node, 0] >= 0).any():  # down to the leaf of the best bounds
            q, pair = every[inner], tree.child[node[inner]]
            left, right = (self.bound(tree, q, pair[:, side]) for side in (0, 1))
            node[inner] = np.where(left >= right, pair[:, 0], pair[:, 1])
        home, scored = node, 0
        for leaf in np.unique(home):
            own = every[home == leaf]
            own = own[self.bound(tree, own, np.full(len(own), leaf)) >= self.kth[own]]
            self.add(tree, ids, first, leaf, own)
            scored += len(own)
        q, node, leaves = every, np.zeros(len(every), np.int64), []
        while len(q):  # level by level, without what the kth score rules out
            bound = self.bound(tree, q, node)
            alive = bound >= self.kth[q]
            q, node, bound = q[alive], node[alive], bound[alive]
            end = tree.child[node, 0] < 0
            leaves.append((q[end], node[end], bound[end]))
            q, node = np.repeat(q[~end], 2), tree.child[node[~end]].ravel()
        q, node, bound = (np.concatenate(x) for x in zip(*leaves, strict=True)) if leaves else (np.zeros(0, np.int64),) * 3
        new = node != home[q]
        q, node, bound = q[new], node[new], bound[new]
        order = np.lexsort((-bound, q))
        q, node, bound = q[order], node[order], bound[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        turn = np.minimum(np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))), turns)
        for k in range(turns + 1):  # each query's best leaves one by one, then the others
            own, at, upper = q[turn == k], node[turn == k], bound[turn == k]
            by_leaf = np.argsort(at, kind="stable")
            for rows in np.split(by_leaf, np.flatnonzero(np.diff(at[by_leaf])) + 1) if len(own) else ():
                rows = rows[upper[rows] >= self.kth[own[rows]]]
                if len(rows):
                    self.add(tree, ids, first, int(at[rows[0]]), own[rows])
                    scored += len(rows)
        return scored

    def bound(self, tree: BallTree, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for at in range(0, len(q), 8192):
            part = q[at : at + 8192]
            out[at : at + 8192] = tree.bounds(self.real[part], self.length[part], node[at : at + 8192])
        return out


def _trees(table: pa.Table) -> pa.Table:
    """One row for the points of a shard that have one dimension."""
    dim = table.column("dim")[0].as_py()
    points = np.array(table.column("v").combine_chunks().flatten(), np.int64).reshape(-1, dim)
    own = table.column("ids").combine_chunks()
    tree, order = BallTree.build(points)
    lists = own.take(pa.array(order))
    n_ids = np.array(lists.value_lengths(), np.int32)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= points.min() and points.max() <= np.iinfo(k).max)
    row = {
        "shard": table.column("shard")[0].as_py(), "dim": dim, "kind": kind, "points": tree.points.astype(kind).tobytes(),
        "ids": np.array(lists.flatten(), "<i8").tobytes(), "n_ids": n_ids.astype("<i4").tobytes(), "span": tree.span.astype("<i4").tobytes(),
        "child": tree.child.astype("<i4").tobytes(), "centre": tree.centre.astype("<f8").tobytes(), "radius": tree.radius.astype("<f8").tobytes(),
    }
    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 7]
    return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


def _searched(blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """Searches all trees of a task for a block of queries: by dimension ids, vectors and scores to beat."""

    def run(batches):
        best = {dim: Best(*block, k) for dim, block in blocks.items()}
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(1)[i].as_py()
                if dim not in best:
                    continue
                kind, points, ids, n_ids, span, child, centre, radius = (b.column(c)[i].as_py() for c in range(2, 10))
                tree = BallTree(
                    np.frombuffer(points, kind).astype(np.int64).reshape(-1, dim), np.frombuffer(span, "<i4").reshape(-1, 2), np.frombuffer(child, "<i4").astype(np.int64).reshape(-1, 2),
                    np.frombuffer(centre, "<f8").reshape(-1, dim), np.frombuffer(radius, "<f8"),
                )
                best[dim].search(tree, np.frombuffer(ids, "<i8"), np.concatenate([[0], np.cumsum(np.frombuffer(n_ids, "<i4"))]))
        for own in best.values():
            q, score, x = own.found
            yield pa.RecordBatch.from_arrays([pa.array(own.query_ids[q]), pa.array(x), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, shard_rows: int = 8_192, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best candidates of each query.

    ``vectors`` and ``queries``: vec_id long, v array<bigint> (see :func:`integers`). A query
    is never its own candidate (by vec_id). Ties go to the smaller vec_id. Fewer than ``k``
    candidates: all of them; none: no rows for that query. Vectors of another length than the
    query's are not comparable and no candidates, empty ones have none. Repeated rows count once;
    a vec_id with several vectors is asked and found by each, a pair with its best score. Scores
    beyond the range of long take its nearest end. Further columns are ignored. ``shard_rows``
    bounds a tree; ``block_bytes`` the vectors of a block of queries, which the driver passes on to
    all tasks, one block after another."""
    spark = vectors.sparkSession
    usable = F.size("v") > 0
    # equal vectors: k + 1 smallest ids are enough, as a query can only exclude itself
    rows = vectors.select("vec_id", "v").filter(usable).distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    part = salted.withColumn("nth", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    same = Window.partitionBy("v").orderBy("vec_id")
    points = part.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points.withColumn("h", F.xxhash64("v")), "points")
    n_shards = max(1, -(-points.count() // shard_rows))
    dealt = points.select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "ids", "v")
    trees = materialize(dealt.groupBy("shard", "dim").applyInArrow(_trees, TREES), "trees", rows_per_file=16)

    asked = materialize(queries.select("vec_id", "v").filter(usable).distinct().withColumn("h", F.xxhash64("vec_id", F.lit(9))), "queries")
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_blocks = max(1, -(-int(n) * 8 * int(dim or 1) // block_bytes))
    first = max(1, n_shards // 16)
    tag = f"hits-{uuid.uuid4().hex}"
    for block in range(n_blocks):
        own: dict[int, list] = {}
        for r in asked.filter(F.pmod("h", F.lit(n_blocks)) == block).select("vec_id", "v").toLocalIterator():  # bounded by block_bytes
            own.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
        if not own:
            continue
        arrays = {d: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.int64)) for d, rows in own.items()}
        floors: dict[int, int] = {}
        for head in (True, False):
            if not head and n_shards == first:
                continue
            sent = {d: (ids, v, np.array([floors.get(i, LOWEST) for i in ids.tolist()], np.int64)) for d, (ids, v) in arrays.items()}
            here = trees.filter(F.col("shard") < first if head else F.col("shard") >= first)
            hits = materialize(here.mapInArrow(_searched(sent, k), HITS), tag, "uncompressed")
            if head and n_shards > first:
                pairs = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                kth = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).filter(F.size("s") >= k)
                floors = {r[0]: r[1] for r in kth.select("query_id", F.col("s")[k - 1]).toLocalIterator()}
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = spark.read.schema(HITS).parquet(f"{shared_dir(spark)}/codelake-{tag}-*")
    pairs = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
