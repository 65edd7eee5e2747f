"""Rows whose further columns travel as one, so that no name of theirs can clash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = ("doc_id", "text")


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``rest``: a struct of all other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in KEEP]
    return docs.select(*KEEP, (F.struct(*others) if others else F.lit(0)).alias("rest"))


def unpack(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that :func:`pack` was given, in their order."""
    return rows.select(*[F.col(c) if c in KEEP else F.col("rest").getField(c).alias(c) for c in columns])
