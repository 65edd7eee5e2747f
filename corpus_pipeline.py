"""A training corpus from documents: five stages, each an operator of ``codelake.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where docs is the
written result of the stage before, and returns a DataFrame. All but the last return the
columns of documents. What a stage left in the shared folder is deleted when the next one
begins, so its result has to be written by then, as :func:`run` does.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm import decontam, line_dedup, minhash, packing, rows, store, toxicity
from codelake.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_own = threading.local()


def _stage(f: Stage) -> Stage:
    """Deletes the intermediate tables of the stage that this thread ran before."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.release(spark, *getattr(_own, "left", (0, 0)))
        start = store.mark()
        out = f(spark, docs, sf_dir)
        _own.left = start, store.mark()
        return out

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5.

    Null or empty texts score low and stay, as do rows without a doc_id; repeated rows go or stay
    together. No or too few labels: the seed lexicon decides."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(rows.pack(docs), model, carry=("doc_id", "text", "rest"))
    return rows.unpack(scored.filter(F.col("score") < 0.5), docs.columns)


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents or more share, but for one document.

    All rows stay. Null text becomes empty; n_chars, where there is one, is that of the new text.
    Rows without a doc_id count as one document, repeated rows too."""
    return _with_size(line_dedup.dedup_lines(docs))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.

    Different texts under one doc_id are different documents here, and stay both unless they are
    linked; rows that are equal in doc_id and text stay once. Documents without words stay; rows
    without a doc_id all stay."""
    kept = minhash.representatives(docs.select("doc_id", "text")).select(F.col("doc_id").alias("own_id"), F.col("t").alias("own_t"))
    packed = rows.pack(docs)
    t = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    known = packed.withColumn("t", t).join(kept, (F.col("doc_id") == F.col("own_id")) & (F.col("t") == F.col("own_t")), "left_semi")
    once = known.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "t").orderBy(F.lit(0)))).filter("nth = 1")
    return rows.unpack(once.select(packed.columns).unionByName(packed.filter("doc_id is null")), docs.columns)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null or empty texts and an empty benchmark: all stay. Repeated rows, and rows without a doc_id,
    go or stay by their own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = rows.pack(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    leaks = decontam.contaminated(keyed.select(F.col("row").alias("doc_id"), "text"), benchmark)
    clean = keyed.join(leaks.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti")
    return rows.unpack(clean, docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    Null or empty text: the one end token. Rows without a doc_id and repeated rows: each is packed."""
    pieces = packing.pack(docs, tokenizer_path(), 1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Stages train models and tokenise, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = store.mark()
        written = store.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            store.release(spark, before - 1, before)
        docs = written
    return docs
