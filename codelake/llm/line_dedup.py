"""Dropping lines that many documents share. DataFrame functions only.

Keys of lines become 128-bit hashes, range-partitioned by (hash, document) and sorted by
(hash, document, position), so that a key's first occurrence in each document is met as
the partition is streamed; a hash that a third of all lines carry spreads over many
partitions, as the document is part of the range. The few lines that make up a large share of all
are sent to their occurrences, so that no task gets all of these. The answer travels as sparse bitmaps: 64
lines a word, and only the words that drop a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import pack, unpack
from .store import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shared lines with this share of all their documents are sent to the lines, not the lines to them.
HOT_SHARE = 1024
#: Stripped at both ends of a line: space and \x09-\x0D.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() equals the ASCII mapping on pure ASCII, where it is much faster
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash and all further columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"text": text, "_hash": F.xxhash64(text)})


def drop_words(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, _hash (of the text), drop: array of (word, bits), where bit b of word w is set
    if line 64 * w + b is dropped. Only documents that lose a line have a row."""
    lines = _lines(docs).select("doc_id", "_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    keyed = materialize(keyed.select("doc_id", "_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), F.col("key")).alias("h2")), "line-keys")
    streamed = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    first = keyed.select("h1", "h2", "doc_id", "pos").repartitionByRange("h1", "h2", "doc_id").withColumn("nth", F.row_number().over(streamed)).filter("nth = 1")
    shared = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    shared = materialize(shared.filter(F.col("n_docs") >= min_docs), "shared-lines")
    # HOT_SHARE lines at most can have so many documents, whatever the size of the corpus; all others are small groups
    total = shared.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.broadcast(shared.filter(F.col("n_docs") >= max(min_docs, 64, total // HOT_SHARE)).select("h1", "h2", F.col("keeper").alias("hot_keeper")))
    near = keyed.join(hot, ["h1", "h2"], "left")
    met = near.filter("hot_keeper is null").drop("hot_keeper").join(shared.drop("n_docs"), ["h1", "h2"])
    met = met.unionByName(near.filter("hot_keeper is not null").withColumnRenamed("hot_keeper", "keeper"))
    dropped = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    word = F.shiftright("pos", 6).alias("word")
    bit = F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    words = dropped.groupBy("doc_id", "_hash", word).agg(bit)
    return words.groupBy("doc_id", "_hash").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drop"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with n_lines, n_dropped and drop (see :func:`drop_words`; null: all lines stay).

    A line is dropped if its key (see :func:`line_key`) has ``min_chars`` code points or more
    and occurs in ``min_docs`` documents or more, unless its document has the largest doc_id
    of those that hold the key; that one keeps all its copies.

    Null text: as empty, one empty line. Null doc_id: all such rows count as one document,
    smaller than any other. Repeated rows: one document to the counts; each row gets its
    answer. No rows: none. Further columns are carried along, whatever their names, but for
    names in this result, which are replaced. If ``text`` isn't used later, it isn't shuffled."""
    own = "_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = drop_words(docs.select("doc_id", "text"), min_docs, min_chars)
    words = words.select(F.col("doc_id").alias(f"{own}doc"), F.col("_hash").alias(f"{own}hash"), "drop").hint("shuffle_hash")
    rows = docs.drop("drop", "n_lines", "n_dropped").withColumns({"text": text, f"{own}text": F.xxhash64(text), "n_lines": F.size(F.split(text, "\n")).cast("long")})
    rows = rows.join(words, F.col("doc_id").eqNullSafe(F.col(f"{own}doc")) & (F.col(f"{own}text") == F.col(f"{own}hash")), "left").drop(f"{own}doc", f"{own}hash", f"{own}text")
    n = F.aggregate(F.coalesce("drop", F.array().cast("array<struct<word:int,bits:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["bits"]))
    return rows.withColumn("n_dropped", n)


def kept_text() -> Column:
    """The lines that stay, joined by newlines, from the columns text and drop.

    The sparse words are spread to one flag a line first, so that each line is looked at once."""
    none = F.array().cast("array<bigint>")
    dense = F.aggregate("drop", none, lambda a, w: F.concat(a, F.array_repeat(F.lit(0).cast("bigint"), w["word"] - F.size(a)), F.array(w["bits"])))
    flags = F.flatten(F.transform(dense, lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w, b))))
    # array_join leaves nulls out
    kept = F.zip_with(F.split("text", "\n"), flags, lambda line, gone: F.when(F.coalesce(gone, F.lit(0)) == 0, line))
    return F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``."""
    rows = keep_bitmaps(pack(docs), min_docs, min_chars).withColumn("text", kept_text())
    return unpack(rows, docs.columns)
