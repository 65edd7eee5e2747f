"""Vector compression by product codes, with codebooks from filtering Lloyd rounds.

Vectors become integers and are cut into four equal parts. Every partition of the input builds
kd-trees over its parts, one for each part position and piece of ``shard_rows`` rows, with the bounding box,
count and sum of each node, and writes them once. A round walks down the trees with the codebook: at a
node, entries that some other entry beats in the whole box are eliminated, and where one is left, the whole
subtree is assigned at once by its cached sum and count. Entries' sums and counts are added up by Spark; only
these, which don't grow with the rows, reach the driver. Rows are not shuffled at all.

All is exact: arithmetic is on whole numbers, in floats while they hold these exactly, else in
64 bits, else in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import materialize

PARTS, ENTRIES = 4, 256
MOST = (1 << 63) - 1
SUMS = "part int, entry int, place int, n long, high long, low long"
TREE = "part int, order binary, span binary, child binary, low binary, high binary, total binary"


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, label, v = floor(scale * component) as array<bigint>; rows without a usable vector go.

    Components beyond the range of long take its nearest end."""
    clean = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(double(x)) and abs(double(x)) < double('infinity'))")
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(clean).select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("v")).filter(f"size(v) > 0 and size(v) % {PARTS} = 0")


def work_type(*arrays: np.ndarray) -> type:
    """A type that holds every sum below exactly, for components as large as those given."""
    most = max([1, *(max(int(a.max()), -int(a.min())) for a in arrays if a.size)])
    bound = 16 * most * most * max(a.shape[-1] for a in arrays)
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class PartTree:
    """A kd-tree over integer points: node i holds the rows order[span[i, 0]:span[i, 1]]."""

    def __init__(self, points, order, span, child, low, high, total):
        self.points, self.order, self.span, self.child, self.low, self.high, self.total = points, order, span, child, low, high, total

    @staticmethod
    def build(points: np.ndarray, leaf: int = 32) -> PartTree:
        """Split at the median of the widest side. A box that is one point is a leaf, however many rows it holds."""
        order = np.arange(len(points))
        span, child, low, high = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own = points[order[start:end]]
            lo, hi = own.min(0), own.max(0)
            node = len(span)
            span.append((start, end))
            child.append([-1, -1])
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                child[parent][side] = node
            wide = [int(b) - int(a) for a, b in zip(lo, hi, strict=True)]
            if end - start > leaf and max(wide) > 0:
                axis, half = wide.index(max(wide)), (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, axis], half)]
                todo += [(start, start + half, node, 0), (start + half, end, node, 1)]
        span = np.array(span)
        wide = max(int(points.max()), -int(points.min()), 1) * len(points) > MOST
        run = np.cumsum(np.vstack([np.zeros_like(points[:1]), points[order]]).astype(object if wide else np.int64), axis=0)
        return PartTree(points, order, span, np.array(child), np.array(low), np.array(high), run[span[:, 1]] - run[span[:, 0]])

    def filter(self, book: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray]], int]:
        """Nearest entries of all points, ties to the lower index: (node, entry) for subtrees that are
        assigned as a whole, (rows, entries) for points that are assigned singly, and how many (point, entry)
        distances that took."""
        kind = work_type(self.points, book)
        c = book.astype(kind)
        norm = (c * c).sum(1)
        whole, single, met = [], [], 0
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        while len(nodes):
            keep = []
            for at in range(0, len(nodes), 1024):
                own, left = nodes[at : at + 1024], alive[at : at + 1024]
                twice, size = (self.low[own].astype(kind) + self.high[own].astype(kind)), (self.high[own].astype(kind) - self.low[own].astype(kind))
                best = _least(norm - twice @ c.T, left)  # nearest to the middle of the box
                for z in np.unique(best):
                    at_z = np.flatnonzero(best == z)
                    # least of |x - entry|^2 - |x - z|^2 over the box, whose corner is chosen by the signs of entry - z
                    least = (norm - norm[z]) - twice[at_z] @ (c - c[z]).T - size[at_z] @ abs(c - c[z]).T
                    beaten = (least > 0) | ((least == 0) & (np.arange(len(c)) > z))
                    left[at_z] &= ~beaten.astype(bool)
                keep.append(left)
            alive = np.concatenate(keep)
            one = alive.sum(1) == 1
            whole += list(zip(nodes[one].tolist(), alive[one].argmax(1).tolist(), strict=True))
            open_, alive = nodes[~one], alive[~one]
            end = self.child[open_, 0] < 0
            for node, left in zip(open_[end], alive[end], strict=True):
                rows, entries = self.order[slice(*self.span[node])], np.flatnonzero(left)
                away = norm[entries] - 2 * (self.points[rows].astype(kind) @ c[entries].T)
                single.append((rows, entries[_argmin(away)]))
                met += away.size
            nodes, alive = self.child[open_[~end]].ravel(), np.repeat(alive[~end], 2, axis=0)
        return whole, single, met

    def gathered(self, book: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Count and componentwise sum of the points of each entry."""
        whole, single, _ = self.filter(book)
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, self.total.dtype)
        for node, z in whole:
            count[z] += self.span[node, 1] - self.span[node, 0]
            total[z] += self.total[node]
        for rows, entries in single:
            np.add.at(count, entries, 1)
            np.add.at(total, entries, self.points[rows])
        return count, total.tolist()

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point."""
        whole, single, _ = self.filter(book)
        entry = np.zeros(len(self.points), np.int64)
        for node, z in whole:
            entry[self.order[slice(*self.span[node])]] = z
        for rows, entries in single:
            entry[rows] = entries
        kind = work_type(self.points, book)
        return entry, ((self.points.astype(kind) - book.astype(kind)[entry]) ** 2).sum(1)


def _least(score: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Column of the least score of each row among those left, the first of equals."""
    if score.dtype == object:
        return np.array([min(np.flatnonzero(m), key=lambda i: (s[i], i)) for s, m in zip(score, left, strict=True)])
    top = np.inf if score.dtype == np.float64 else MOST
    return np.where(left, score, top).argmin(1)


def _argmin(score: np.ndarray) -> np.ndarray:
    return np.array([min(range(len(s)), key=lambda i: s[i]) for s in score]) if score.dtype == object else score.argmin(1)


def _small(values: np.ndarray) -> tuple[str, bytes]:
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= values.min() and values.max() <= np.iinfo(k).max)
    return kind, values.astype(kind).tobytes()


def _shards(dim: int, shard_rows: int, label: pa.DataType):
    """Pieces of a partition as rows: vec_ids, labels, the points, and a tree for each part."""
    tree_type = pa.struct([("part", pa.int32()), *((n, pa.binary()) for n in ("order", "span", "child", "low", "high", "total"))])

    def shard(table: pa.Table) -> pa.RecordBatch:
        points = np.array(table.column("v").combine_chunks().flatten(), np.int64).reshape(-1, dim)
        kind, packed = _small(points)
        trees = []
        for part, own in enumerate(np.split(points, PARTS, axis=1)):
            t = PartTree.build(np.ascontiguousarray(own))
            total = b"" if t.total.dtype == object else t.total.astype("<i8").tobytes()
            trees.append({"part": part, "order": t.order.astype("<i4").tobytes(), "span": t.span.astype("<i4").tobytes(), "child": t.child.astype("<i4").tobytes(), "low": t.low.astype("<i8").tobytes(), "high": t.high.astype("<i8").tobytes(), "total": total})
        one = lambda name, t: pa.array([table.column(name).to_pylist()], pa.list_(t))
        return pa.RecordBatch.from_arrays([one("vec_id", pa.int64()), one("label", label), pa.array([kind]), pa.array([packed], pa.binary()), pa.array([trees], pa.list_(tree_type))], names=["vec_ids", "labels", "kind", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, shard_rows):
                piece = b.slice(at, shard_rows)
                if n and n + piece.num_rows > shard_rows:
                    yield shard(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield shard(pa.Table.from_batches(held))

    return run


def _trees(b: pa.RecordBatch, i: int, dim: int) -> Iterator[tuple[int, PartTree]]:
    """The trees of a written shard."""
    points = np.frombuffer(b.column("points")[i].as_py(), b.column("kind")[i].as_py()).astype(np.int64).reshape(-1, dim)
    width = dim // PARTS
    for t in b.column("trees")[i].as_py():
        own = np.ascontiguousarray(points[:, t["part"] * width : (t["part"] + 1) * width])
        read = lambda name, columns, kind="<i4": np.frombuffer(t[name], kind).astype(np.int64).reshape(-1, columns)  # noqa: B023, E731
        order, span = read("order", 1)[:, 0], read("span", 2)
        if t["total"]:
            total = read("total", width, "<i8")
        else:
            total = np.array([own[order[a:e]].astype(object).sum(0) for a, e in span], object)
        yield t["part"], PartTree(own, order, span, read("child", 2), read("low", width, "<i8"), read("high", width, "<i8"), total)


def _summed(books: np.ndarray, dim: int):
    """Counts and sums by part, entry and place over all shards of a task. A sum is high * 2^32 + low."""

    def run(batches):
        count = np.zeros(books.shape[:2], np.int64)
        total = [[[0] * books.shape[2] for _ in own] for own in books]
        for b in batches:
            for i in range(b.num_rows):
                for part, tree in _trees(b, i, dim):
                    n, sums = tree.gathered(books[part])
                    count[part] += n
                    for z in np.flatnonzero(n):
                        total[part][z] = [x + int(y) for x, y in zip(total[part][z], sums[z], strict=True)]
        rows = [(p, z, k, int(count[p, z]), x >> 32, x & 0xFFFFFFFF) for p, z in np.argwhere(count).tolist() for k, x in enumerate(total[p][z])]
        if rows:
            kinds = [pa.int32()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "entry", "place", "n", "high", "low"])

    return run


def _coded(books: np.ndarray, dim: int, label: pa.DataType):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                found = [tree.assigned(books[part]) for part, tree in _trees(b, i, dim)]
                codes = np.stack([entry for entry, _ in found], 1).astype(np.uint8).tobytes().hex()
                error = [min(MOST, sum(int(x) for x in own)) for own in zip(*(away.tolist() for _, away in found), strict=True)]
                n = 2 * PARTS
                code = pa.array([codes[k : k + n] for k in range(0, len(codes), n)])
                yield pa.RecordBatch.from_arrays([b.column("vec_ids")[i].values, b.column("labels")[i].values.cast(label), code, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def lloyd(shards: DataFrame, books: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The codebooks (part, entry, place) after so many rounds; entries that no part is nearest to stay."""
    dim = PARTS * books.shape[2]
    for _ in range(rounds):
        sums = shards.mapInArrow(_summed(books, dim), SUMS).groupBy("part", "entry", "place").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
        books = books.copy()
        for r in sums.collect():  # as many as the codebooks have components
            books[r["part"], r["entry"], r["place"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _by_label(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error. Labels of a 128th of all rows or more are sent to the rows."""
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    sums = materialize(rows.groupBy("label").agg(whole.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    n = sums.agg(F.sum("n")).first()[0] or 0
    often = sums.filter(F.col("n") >= max(1000, n // 128)).select(F.col("label").alias("own"), F.col("label_error").alias("hot"))
    rows = rows.join(F.broadcast(often), F.col("label").eqNullSafe(F.col("own")), "left").drop("own")
    rest = rows.filter("hot is null").drop("hot").join(sums.select(F.col("label").alias("own"), "label_error"), F.col("label").eqNullSafe(F.col("own"))).drop("own")
    return rest.unionByName(rows.filter("hot is not null").withColumnRenamed("hot", "label_error"))


def compress(vectors: DataFrame, rounds: int = 4, *, shard_rows: int = 16_384) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each vector that :func:`usable` keeps.

    ``vectors``: vec_id, embedding, label. Each part position has a codebook of up to 256 entries,
    which begins as the parts of the first rows by (vec_id, vector). ``code`` has two hex digits a
    part, ``error`` is the squared distance of a vector from what its code stands for.

    Vectors that are null, empty, not finite in all components, or whose length is no multiple of
    four are dropped; so are those of another length than the first row's. Null vec_id: like
    others, after all. Null label: these count as one label. Repeated rows: each has its row and
    weighs in the codebooks. Fewer than 256 rows: as many entries. No rows: none. Components and errors
    beyond the range of long take its nearest end. Further columns are ignored."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    label = rows.schema["label"].dataType
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    out = f"vec_id long, label {label.simpleString()}, code string, error long"
    if not first:
        return spark.createDataFrame([], f"{out}, label_error long, codebooks_sha256 string")
    dim = len(first[0]["v"])
    if any(len(r["v"]) != dim for r in first):
        first = rows.filter(F.size("v") == dim).select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = np.stack(np.split(np.array([r["v"] for r in first], np.int64), PARTS, axis=1))
    arrow = to_arrow_type(label)
    schema = f"vec_ids array<bigint>, labels array<{label.simpleString()}>, kind string, points binary, trees array<struct<{TREE.replace(' ', ':').replace(',:', ',')}>>"
    shards = materialize(rows.filter(F.size("v") == dim).mapInArrow(_shards(dim, shard_rows, arrow), schema), "part-trees", rows_per_file=16)
    books = lloyd(shards, books, rounds)
    coded = materialize(shards.mapInArrow(_coded(books, dim, arrow), out), "codes")
    return _by_label(coded).select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
