"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A change is an insert (+count), a delete (-count) or a revision (-old, +new, each under its own
source, language and version). A batch is reduced to its sums and written once; totals are the
sum over the committed batches. A batch is committed when its manifest exists, which one atomic
rename decides: a batch that is sent again, or by two writers, counts once; one that broke off
before the rename counts not at all. That needs a file system whose rename of a folder is
atomic (HDFS or local, not a plain object store). Many small batches are summed into a snapshot
by :meth:`Rollup.compact`, which a rename publishes likewise.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, shared_dir
from .words import encode

KEYS = ("source", "lang", "tokenizer")
CHANGE = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Sums of a batch of changes: KEYS, n_docs, n_tokens; keys whose sums are 0 go.

    ``op``: insert adds the new values, delete takes the old ones off, revise does both; other
    ops raise. Old keys that are null fall back on the new ones only if all three are null. Null
    counts are 0. Null keys are keys of their own."""
    bad = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(bad)
    moved = F.col("old_source").isNotNull() | F.col("old_lang").isNotNull() | F.col("old_tokenizer").isNotNull()
    old = [F.when(moved, F.col(f"old_{k}")).otherwise(F.col(k)).alias(k) for k in KEYS]
    new_row = F.struct(*[F.col(k).alias(k) for k in KEYS], F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    old_row = F.struct(*old, F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("old_n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    rows = F.when(op == "insert", F.array(new_row)).when(F.col("op") == "delete", F.array(old_row)).otherwise(F.array(old_row, new_row))
    sums = changes.select(F.inline(rows)).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.filter("n_docs <> 0 or n_tokens <> 0")


class Rollup:
    """A rollup in a folder (any Hadoop file system) that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def committed(self) -> dict[str, str]:
        """Names and folders of the committed batches."""
        at = self._path(f"{self.path}/batches")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return {n: f"{self.path}/batches/{n}" for n in sorted(names) if not n.startswith(".")}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and no effect, if a batch of that name is committed already."""
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.committed():
            return False
        mine = f"{self.path}/open/{batch}-{uuid.uuid4().hex}"
        signed(changes).write.parquet(mine)
        self._fs.mkdirs(self._path(f"{self.path}/batches"))
        if self._claim(mine, f"{self.path}/batches/{batch}"):
            return True
        self._fs.delete(self._path(mine), True)
        return False

    def _claim(self, source: str, target: str) -> bool:
        """Rename, unless the target exists; the file system decides between two writers."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)
        try:
            context.rename(self._path(source), self._path(target), no_options)
        except Exception:
            if self._fs.exists(self._path(target)):
                return False
            raise
        return True

    def _snapshot(self) -> tuple[int, list[str], set[str]]:
        """The number of the newest snapshot (0: none), the paths of its sums, the batches in it."""
        at = self._path(f"{self.path}/snapshots")
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        if not numbers:
            return 0, [], set()
        newest = f"{self.path}/snapshots/{max(numbers):012d}"
        names = self.spark.read.schema("batch string").parquet(f"{newest}/batches").collect()
        return max(numbers), [f"{newest}/sums"], {r["batch"] for r in names}

    def _sources(self) -> tuple[int, list[str], list[str]]:
        """The newest snapshot's number, the paths that make up the totals, the batches they hold."""
        number, paths, inside = self._snapshot()
        batches = self.committed()
        return number, paths + [p for n, p in batches.items() if n not in inside], sorted(batches)

    def compact(self) -> bool:
        """Sum the newest snapshot and the batches after it into one snapshot, which totals then
        read instead. Batches keep their names, so that one sent again still counts once. False,
        and no effect, without a new batch or if another writer has published that number."""
        number, paths, names = self._sources()
        if not paths or (number and len(paths) == 1):
            return False
        mine = f"{self.path}/open/snapshot-{uuid.uuid4().hex}"
        self._sums(paths).write.parquet(f"{mine}/sums")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{mine}/batches")
        self._fs.mkdirs(self._path(f"{self.path}/snapshots"))
        if self._claim(mine, f"{self.path}/snapshots/{number + 1:012d}"):
            return True
        self._fs.delete(self._path(mine), True)
        return False

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all committed batches; keys without documents go."""
        paths = self._sources()[1]
        return self._sums(paths) if paths else self.spark.createDataFrame([], DELTA)

    def _sums(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


#: A piece between white space that holds no letter, digit or underscore.
MARKS = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, n_pieces (between white space), n_words (those with a letter or digit)
    and n_tokens of the whole text (null: 0) for every row."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            pieces = np.array([len(t.split()) for t in texts], np.int64)
            marks = np.array([len(MARKS.findall(t)) for t in texts], np.int64)
            tokens = np.array([len(encode(tokenizer, t)) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(pieces), pa.array(pieces - marks), pa.array(tokens)], names=["doc_id", "source", "lang", "n_pieces", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_pieces long, n_words long, n_tokens long")


def change(op: str, version: str, *, old: str | None = None, new: str | None = None, old_lang: Column | None = None, new_lang: Column | None = None) -> list[Column]:
    """The columns of CHANGE over rows of :func:`count_tokens`; ``old`` and ``new`` name their counts."""
    none, count = F.lit(None).cast("string"), F.lit(None).cast("long")
    lang = F.col("lang")
    return [
        F.lit(op).alias("op"),
        F.col("doc_id"),
        F.col("source"),
        (lang if new_lang is None else new_lang).alias("lang"),
        F.lit(version).alias("tokenizer"),
        (F.col(new) if new else count).alias("n_tokens"),
        (F.col("source") if old else none).alias("old_source"),
        ((lang if old_lang is None else old_lang) if old else none).alias("old_lang"),
        (F.lit(version) if old else none).alias("old_tokenizer"),
        (F.col(old) if old else count).alias("old_n_tokens"),
    ]


def corpus_rollup(docs: DataFrame, labels: DataFrame, tokenizer: str, path: str | None = None, name: str = "corpus") -> DataFrame:
    """A rollup over the whole corpus, by four batches. Returns its totals: source, lang, tokenizer,
    n_docs, n_tokens.

    Loads: pieces between white space (version ``words``), and ids of the vocabulary (``bpe``), a
    batch that is sent twice. A revision: ``words`` without pieces that are marks only, and under
    ``und`` where the language is null. A deletion: documents with a label of quality 0.

    Null text counts 0 tokens. Repeated rows count each. A document is deleted if any label row
    of its doc_id has quality 0; null doc_ids are never deleted. No rows: no totals.

    The batches are named after ``name``. A further corpus in the same ``path`` needs a name of its
    own; under the same name it is the same corpus sent again, and counts once."""
    spark = docs.sparkSession
    counts = materialize(count_tokens(docs, tokenizer), "token-counts")
    named = F.coalesce("lang", F.lit("und"))
    bad = labels.filter("quality = 0 and doc_id is not null").select("doc_id").distinct()
    gone = counts.join(bad, "doc_id", "left_semi")
    rollup = Rollup(spark, path or f"{shared_dir(spark)}/codelake-rollup-{uuid.uuid4().hex}")
    rollup.commit(f"{name}-load-words", counts.select(change("insert", "words", new="n_pieces")))
    load = counts.select(change("insert", "bpe", new="n_tokens"))
    rollup.commit(f"{name}-load-bpe", load)
    rollup.commit(f"{name}-load-bpe", load)  # sent again: no effect
    wrong = counts.filter("lang is null or n_words <> n_pieces")
    rollup.commit(f"{name}-revise-words", wrong.select(change("revise", "words", old="n_pieces", new="n_words", new_lang=named)))
    deleted = gone.select(change("delete", "words", old="n_words", old_lang=named))
    rollup.commit(f"{name}-delete-low-quality", deleted.unionByName(gone.select(change("delete", "bpe", old="n_tokens"))))
    return rollup.totals()
