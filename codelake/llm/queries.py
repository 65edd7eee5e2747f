"""The queries of this folder, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, divergence, langid, licenses, line_dedup, minhash, packing, pii, token_rollup, topk, toxicity
from .sql import ORACLE_SQL


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), 1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.keep_bitmaps(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(line_dedup.kept_text().cast("binary"), 256)
    return rows.select("doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rare_words=False)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.corpus_rollup(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), tokenizer_path())


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of ``spark.codelake.pii.key``; without one, a key of this run that nobody
    learns, so that surrogates of two runs don't agree. Who loads a corpus in several runs sets the key."""
    key = (spark.conf.get("spark.codelake.pii.key", None) or "").encode() or secrets.token_bytes(32)
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of number -7 whose texts are control strings."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), said) for k, role in enumerate(("user", "assistant"))]
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.range(1).select(F.inline(F.array(*own))))
    return chat.digests(chat.windows(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_line_dedup, op3_toxicity, op4_langid, op5_decontamination, op6_licenses, op7_token_counts, op8_near_dedup, op9_topk, op10_pii, op11_divergence, op12_codes, op13_chat)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
