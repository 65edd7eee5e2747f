"""How far the sources of a language differ in their words. Plain relational, but for the counts of a task's texts.

Terms of the whole texts, and the documents that hold them, are counted by language, source and term in
the task that reads them, over a bounded length of text at a time; such counts, and no single
terms, are shuffled and summed. Each language keeps the terms of ``min_docs`` documents or more. Its groups are then crossed with that vocabulary,
so that absent terms count as zeros, and the dense table meets itself by language and term.

A language may hold most rows: groups meet the vocabulary by language and salt, where the salt is a
hash of the term, and all later joins are by term. The ten
best terms of a group are cut before they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .store import materialize

#: Letters as they are counted and a blank for all that ends a term, by byte of UTF-8: terms are
#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``, and every byte of a character beyond ASCII is 128 or more.
BLANK = 0x20
LETTERS = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else BLANK for b in range(256)], np.uint8)
#: Bytes of text whose terms a task counts at a time; a longer text is counted by itself.
PIECE = 1 << 24
#: Parts of a language's vocabulary that groups are crossed with.
SALTS = 64
#: One, in the whole numbers that stand for shares.
ONE = 1_000_000_000


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(ONE * (count + 2) / (total + 2 * size)), exact for counts of any size."""
    parts = f"({total} + 2 * {size})"
    plain = f"({ONE}L * ({count} + 2)) div {parts}"
    wide = f"(cast({ONE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({parts} as decimal(20,0))"
    return F.expr(f"1L + case when {count} < 9000000000 then {plain} else {wide} end")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pieces(batches: Iterable[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of at most ``piece`` bytes in the last column, or of one row."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < len(ends):
            stop = int(np.searchsorted(ends, before + piece - size, "right"))
            if stop == start and not held:
                stop += 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start, before = stop, int(ends[stop - 1])
            if start < len(ends):
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs; sorts ``keys`` where they are."""
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


def _counted(rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The terms of ``rows(lang, source, text)``, counted by language, source and term."""
    langs, sources = rows.column(0).dictionary_encode(), rows.column(1).dictionary_encode()
    n_sources = len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    text = rows.column(2)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = LETTERS[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    letter = data != BLANK
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = ends[:-1][ends[:-1] < len(data)]  # a text's first letter begins a term, whatever the text before ends with
    start[first] = letter[first]
    doc = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(np.flatnonzero(start), ends)))
    at = np.append(np.flatnonzero(start[letter]), np.count_nonzero(letter)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(data[letter])]).dictionary_encode()
    width, code = max(len(terms.dictionary), 1), terms.indices.to_numpy()
    key, n = _runs(group[doc] * width + code)
    once, _ = _runs(doc * width + code)
    _, docs = _runs(group[once // width] * width + once % width)  # of the same keys
    own = key // width
    # views: the bytes of a text stay as they are, valid or not
    columns = [langs.dictionary.take(pa.array(own // n_sources)), sources.dictionary.take(pa.array(own % n_sources)), terms.dictionary.take(pa.array(key % width))]
    return pa.RecordBatch.from_arrays([c.view(pa.string()) for c in columns] + [pa.array(n), pa.array(docs)], schema=schema)


def term_counts(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    schema = StructType.fromDDL("lang string, source string, term string, n long, docs long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = (pa.RecordBatch.from_arrays([c.cast(pa.binary()) for c in b.columns], names=b.schema.names) for b in batches)
        for rows in _pieces(plain, piece):
            yield _counted(rows, arrow)

    # dealt before they are summed: a task's rows hardly meet, so a sum on its own side saves little
    each = docs.select(none("lang"), none("source"), none("text")).mapInArrow(run, schema).repartition("lang", "source", "term")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(docs: DataFrame, min_docs: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, source, size) of each group, and the dense table: lang, source, term, n, p, q for each
    group and each kept term of its language; p is the group's share of the term, q the language's."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(none("lang"), none("source")).distinct()
    counts = materialize(term_counts(docs), "term-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
    vocabulary = materialize(vocabulary.filter(F.col("docs") >= min_docs).select("lang", "term", "n_lang"), "kept-terms")
    kept = materialize(counts.join(vocabulary.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept-counts")
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("n_lang").alias("total_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = {"size": F.coalesce("size", F.lit(0).cast("long")), "total_lang": F.coalesce("total_lang", F.lit(0).cast("long")), "total": F.coalesce("total", F.lit(0).cast("long"))}
    groups = materialize(groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").withColumns(zero), "groups")
    salted = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crossed = salted.join(spread, ["lang", "salt"]).join(kept, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    dense = crossed.select("lang", "source", "term", "n", share("n", "total", "size").alias("p"), share("n_lang", "total_lang", "size").alias("q"))
    return groups.select("lang", "source", "size"), materialize(dense, "dense-shares")


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each (lang, source) group is from others.

    Part ``pair``: a row for each other source of the language, its value summed over the whole
    vocabulary (0 without one). Part ``term``: the ``top`` terms that the group uses more than its
    language does. Values are :func:`gap` of whole-number shares, larger ones rank first, ties by
    item in byte order.

    Null text, lang or source: as empty; an empty language or source is one like others.
    Texts without terms: their group has pairs and no term. Repeated rows: documents of their
    own. A language with one source: no pairs. No rows: none. Further columns are ignored."""
    groups, dense = shares(docs, min_docs)
    one, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_item"))
    met = one.join(other, ["lang", "term"]).filter("source < item")
    sums = met.groupBy("lang", "source", "item").agg(F.sum(gap("p", "p_item")).alias("value"))
    # languages that keep no term: the pairs of their groups, each of 0
    bare = groups.filter("size = 0").withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    spread = groups.filter("size = 0").select("lang", F.col("source").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sums = sums.unionByName(bare.join(spread, ["lang", "salt"]).filter("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.select("lang", "value", F.inline(ways)).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    words = dense.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    words = words.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).unionByName(words.select(*columns))
