"""Near-duplicate groups: MinHash with tensored banding, every link verified on full sets.

A text's set holds the hashes of its distinct five-word shingles. Equal sets are one class
from the start, known by two 64-bit sums over its elements and its size. Two small collections of ``HALVES`` half keys, of ``ROWS`` minhashes each, are
computed for each class. Every (left, right) pair of half keys is the key of a table, so 84
minhashes make 196 tables of six rows, which would take 1,176 minhashes by plain banding. Two
sets of similarity 0.75 share no key with a probability under 0.001, of 0.8 under 0.0001. The
right halves are only joined on where a left half already met another class.

Members of a table's bucket are first compared with a hub, and links found so are merged into
components, which leaves few buckets that span several components. Their candidates across
components are all tested, in blocks of bounded size and without a row for each pair: a bitmap of
the set gives an exact upper bound of the similarity, and only pairs that it cannot rule out are
compared on full sets. So no bucket is capped, and a chain of near copies that are not all alike
is followed to its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .store import materialize
from .words import ASCII_LOWER

HALVES, ROWS, WORDS, SIMILARITY = 14, 3, 5, 75
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER), np.uint8)
    solid = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    mixed = _mix(raw[solid].astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(8)))
    return _mix(np.add.reduceat(mixed, np.cumsum(size) - size) + size.astype(np.uint64) * _B)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words are one shingle, none are none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(len(w), words)
    h = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        h = _mix(h * _B + w[k : len(w) - n + 1 + k])
    return np.unique(h)


_SEEDS = _mix(np.arange(101, 101 + 2 * HALVES * ROWS, dtype=np.uint64)) | np.uint64(1)


def half_keys(s: np.ndarray) -> np.ndarray:
    """The left, then the right half keys of a non-empty set."""
    low = np.array([(s * seed).min() for seed in _SEEDS]).reshape(2 * HALVES, ROWS)  # odd factors: bijections
    out = low[:, 0]
    for k in range(1, ROWS):
        out = _mix(out * _B + low[:, k])
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of the elements modulo a power of two of at least twice their number (2,048 to 65,536)."""
    bits = min(1 << 16, max(1 << 11, 1 << int(2 * len(s) - 1).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _sketch(batches):
    for b in batches:
        n, h1, h2, keys, maps = [], [], [], [], []
        for t in b.column(b.num_columns - 1):
            s = shingle_set(t.as_py())
            n.append(len(s))
            h1.append(int(_mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            h2.append(int(_mix(s ^ _B).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            keys.append(half_keys(s).view(np.int64) if len(s) else None)
            maps.append(bitmap(s).tobytes() if len(s) else None)
        cols = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=["doc_id", "t", "n_shingles", "h1", "h2", "halves", "bits"])


def _sets(batches):
    for b in batches:
        sets = [shingle_set(t.as_py()).view(np.int64) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["c", "s"])


def _compare(similarity: int):
    def run(batches):
        for b in batches:
            keep = []
            x, y = b.column(2), b.column(3)
            for i in range(len(b)):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q.view(np.uint64), p.view(np.uint64)), len(q) - 1)
                common = int((q[at] == p).sum())
                if 100 * common >= similarity * (len(p) + len(q) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), text.alias("text"))


def _numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with c, a number of its own for each (h1, h2, n_shingles): a hash, drawn again
    if two classes should share one."""
    for turn in range(16):
        out = classes.withColumn("c", F.xxhash64("h1", "h2", "n_shingles", F.lit(turn)))
        if not out.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
            return out
    raise RuntimeError("classes found no numbers of their own")


def _linked(docs: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, t, n_shingles, h1, h2 of all documents, and classes h1, h2, n_shingles, first (its
    smallest doc_id and t) and g (the smallest class number reachable over links)."""
    text = _keyed(docs)
    schema = "doc_id long, t long, n_shingles long, h1 long, h2 long, halves array<long>, bits binary"
    sketches = materialize(text.mapInArrow(_sketch, schema), "sketches")
    usable = sketches.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    first = F.min(F.struct("doc_id", "t")).alias("first")
    classes = materialize(usable.groupBy("h1", "h2", "n_shingles").agg(first, F.first("halves").alias("halves"), F.first("bits").alias("bits")), "classes")
    classes = _numbered(classes)
    members = _buckets(classes)
    crowd = classes.select("c", F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t")).join(members.select("c").distinct(), "c", "left_semi")
    texts = text.join(crowd, ["doc_id", "t"]).select("c", "text")
    sets = texts.mapInArrow(_sets, "c long, s array<long>").groupBy("c").agg(F.first("s").alias("s"))  # equal rows have equal sets
    groups = _merge(classes, members, materialize(sets, "sets"), similarity)
    named = classes.select("h1", "h2", "n_shingles", "first", "c")
    if groups is not None:
        named = named.join(groups, named["c"] == groups["node"], "left").withColumn("c", F.coalesce("component", "c"))
    return sketches.select("doc_id", "t", "n_shingles", "h1", "h2"), materialize(named.select("h1", "h2", "n_shingles", "first", F.col("c").alias("g")), "groups")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``.

    Documents are linked if 100 * intersection >= ``similarity`` * union of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept is doc_id = component_id.

    Null, empty or blank text: an empty set, linked with nothing. Fewer than five words: the
    whole sequence is one shingle. Null doc_id: never linked, component_id null, kept true.
    Repeated rows (equal doc_id and text): equal results; one doc_id with several texts is one
    document, so it joins their groups. Equal sets are always linked. No rows: none. Further
    columns are ignored."""
    rows, named = _linked(docs, similarity)
    key = ["h1", "h2", "n_shingles"]
    several = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y"))
    several = materialize(several.filter("x <> y").select("doc_id"), "repeated-ids", "uncompressed")
    if several.take(1):  # texts of one doc_id are linked by it
        held = rows.join(several, "doc_id", "left_semi").join(named, key).select("doc_id", "g").distinct()
        links = held.join(held.groupBy("doc_id").agg(F.min("g").alias("b")), "doc_id").select(F.col("g").alias("a"), "b").filter("a <> b")
        links = materialize(links, "id-links", "uncompressed")
        if links.take(1):
            joined = components(links)
            named = named.join(joined, named["g"] == joined["node"], "left").withColumn("g", F.coalesce("component", "g")).drop("node", "component")
    least = named.groupBy("g").agg(F.min("first.doc_id").alias("least"))
    named = named.join(least, "g").select(*key, "least")
    out = rows.drop("t").join(named, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def representatives(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id and t (``xxhash64`` of the text, null as empty) of the one document that stays of each
    group of linked texts, that of the smallest doc_id; each pair once.

    Texts are told apart under one doc_id, too. Documents without words stay; rows without a doc_id
    are left out here."""
    rows, named = _linked(docs, similarity)
    first = named.groupBy("g").agg(F.min("first").alias("x")).select("x.doc_id", "x.t")
    return first.unionByName(rows.filter("n_shingles = 0 and doc_id is not null").select("doc_id", "t").distinct())


def _buckets(classes: DataFrame) -> DataFrame:
    """key, c, n for every table bucket that holds two classes or more."""
    right = F.slice("halves", HALVES + 1, HALVES).alias("right")
    left = materialize(classes.select("c", F.col("n_shingles").alias("n"), right, F.posexplode(F.slice("halves", 1, HALVES)).alias("i", "x")), "left-keys")
    met = left.groupBy("i", "x").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    both = left.join(met, ["i", "x"]).select("c", "n", "i", "x", F.posexplode("right").alias("j", "y"))
    keyed = materialize(both.select(F.xxhash64("i", "x", "j", "y").alias("key"), "c", "n"), "keys")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    return materialize(keyed.join(met, "key"), "buckets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_sets = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    return materialize(with_sets.select("a", "b", "sa", "sb").mapInArrow(_compare(similarity), "a long, b long"), "links", "uncompressed")


def _merge(classes: DataFrame, members: DataFrame, sets: DataFrame, similarity: int, star_rounds: int = 2) -> DataFrame | None:
    """node, component of all classes that have a verified link."""
    groups = tested = None
    now = members.withColumns({"p": F.xxhash64("c"), "g": F.col("c")})
    for turn in range(star_rounds + 1):
        span = now.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min(F.struct("p", "c", "n", "g")).alias("hub")).filter("g0 <> g1")
        span = span.select("key", F.col("hub.c").alias("hc"), F.col("hub.n").alias("hn"), F.col("hub.g").alias("hg"))
        now = materialize(now.join(span, "key"), "open-buckets", "uncompressed")
        if not now.take(1):
            return groups
        if turn < star_rounds:
            close = 100 * F.least("n", "hn") >= similarity * F.greatest("n", "hn")  # else the sizes alone rule a link out
            pairs = now.filter((F.col("g") != F.col("hg")) & close).select(F.least("c", "hc").alias("a"), F.greatest("c", "hc").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs", "uncompressed")
            tested = pairs if tested is None else tested.unionByName(pairs)
            now = now.filter("c <> hc").select("key", "c", "n", "p", "g")  # the hub has met all others
        else:
            pairs = materialize(_block_candidates(classes, now.select("c", "g").distinct(), similarity), "pairs", "uncompressed")
        found = _verified(pairs, sets, similarity)
        if found.take(1):
            groups = materialize(components(found, groups), "components", "uncompressed")
            if turn < star_rounds:
                now = now.drop("g").join(groups, now["c"] == groups["node"], "left").select("key", "c", "n", "p", F.coalesce("component", "c").alias("g"))
    return groups


def _block_candidates(classes: DataFrame, open_classes: DataFrame, similarity: int, block: int = 256, task_rows: int = 4_096) -> DataFrame:
    """Distinct pairs (a, b) of open classes of different components that share a table, and whose
    bitmaps don't rule the similarity out.

    Rows are dealt by left half key; in a task the right halves tell which pairs share a table. A
    large bucket is cut into blocks, and each pair of blocks is a task of its own."""
    own = classes.select("c", F.col("n_shingles").alias("n"), "halves", "bits").join(open_classes, "c")
    rows = materialize(own.select("c", "n", "g", "halves", "bits", F.posexplode(F.slice("halves", 1, HALVES)).alias("i", "x")), "open-halves", "uncompressed")
    sizes = rows.groupBy("i", "x").agg(F.count(F.lit(1)).alias("m"), F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1")
    sizes = materialize(sizes.select("i", "x", "m", F.ceil(F.col("m") / block).cast("int").alias("nb")), "open-sizes", "uncompressed")
    tasks = max(1, -(-int(sizes.agg(F.sum("m")).first()[0] or 0) // task_rows))
    dealt = rows.join(sizes, ["i", "x"]).withColumn("b", F.pmod(F.xxhash64("c", F.lit(23)), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("b", "o"), F.greatest("b", "o")
    task = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("i", "x"), F.lit(tasks))).otherwise(F.xxhash64("i", "x", lo, hi))
    dealt = dealt.select(task.alias("task"), "i", "x", lo.alias("lo"), hi.alias("hi"), "b", "c", "n", "g", "halves", "bits")

    def run(table: pa.Table) -> pa.Table:
        a, b = _task_pairs(table, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def _task_pairs(table: pa.Table, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of one task of :func:`_block_candidates`."""
    table = table.combine_chunks()
    col = {k: table.column(k).to_numpy(zero_copy_only=False) for k in ("i", "x", "lo", "hi", "b", "c", "n", "g")}
    halves = np.array(table.column("halves").to_pylist(), np.int64)
    bits = [np.frombuffer(v, np.uint64) for v in table.column("bits").to_pylist()]
    out_a, out_b = [], []
    order = np.lexsort((col["hi"], col["lo"], col["x"], col["i"]))
    same = np.ones(len(order), bool)
    for k in ("i", "x", "lo", "hi"):
        v = col[k][order]
        same[1:] &= v[1:] == v[:-1]
    for rows in np.split(order, np.flatnonzero(~same)):
        if len(rows) < 2:
            continue
        i, lo, hi = int(col["i"][rows[0]]), col["lo"][rows[0]], col["hi"][rows[0]]
        left, right = rows[col["b"][rows] == lo], rows[col["b"][rows] == hi]
        c1, c2, n1, n2 = col["c"][left][:, None], col["c"][right][None, :], col["n"][left][:, None], col["n"][right][None, :]
        ok = (col["g"][left][:, None] != col["g"][right][None, :]) & (100 * np.minimum(n1, n2) >= similarity * np.maximum(n1, n2))
        ok &= c1 < c2 if lo == hi else c1 != c2
        for k in range(i):  # the pair belongs to its first common left half
            ok &= halves[left, k][:, None] != halves[right, k][None, :]
        shared = np.zeros_like(ok)
        for k in range(HALVES, 2 * HALVES):
            shared |= halves[left, k][:, None] == halves[right, k][None, :]
        p, q = np.nonzero(ok & shared)
        for at in range(0, len(p), 4096):
            u, v = left[p[at : at + 4096]], right[q[at : at + 4096]]
            keep = _possible(bits, col["n"], u, v, similarity)
            out_a.append(np.minimum(col["c"][u], col["c"][v])[keep])
            out_b.append(np.maximum(col["c"][u], col["c"][v])[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a) if out_a else none, np.concatenate(out_b) if out_b else none)


def _fold(b: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(b.reshape(-1, words), axis=0) if len(b) > words else b


def _possible(bits: list[np.ndarray], n: np.ndarray, u: np.ndarray, v: np.ndarray, similarity: int) -> np.ndarray:
    """True where the bitmaps allow the similarity. Common elements are at most the common bits and
    the elements that share a bit with another one of their set."""
    out = np.ones(len(u), bool)
    size = np.minimum([len(bits[k]) for k in u], [len(bits[k]) for k in v])
    for words in np.unique(size):
        at = np.flatnonzero(size == words)
        x, y = np.array([_fold(bits[k], words) for k in u[at]]), np.array([_fold(bits[k], words) for k in v[at]])
        common = np.bitwise_count(x & y).sum(1).astype(np.int64)
        one, two = np.bitwise_count(x).sum(1).astype(np.int64), np.bitwise_count(y).sum(1).astype(np.int64)
        most = np.minimum(np.minimum(common + n[u[at]] - one, common + n[v[at]] - two), np.minimum(n[u[at]], n[v[at]]))
        out[at] = 100 * most >= similarity * (n[u[at]] + n[v[at]] - most)
    return out
