"""Tables of one computation, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RESULTS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):  # local-cluster has machines of its own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="codelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete the results that were written so far; their readers must have ended."""
    while _RESULTS:
        delete(spark, _RESULTS.pop())


def result_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a store that a result reads; :func:`release` deletes it."""
    _RESULTS.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _RESULTS[-1]


class Scratch:
    """Each round of a loop is written to a table, so plans stay short and a lost executor costs no
    round. All tables but the result are deleted when the computation ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` without its lineage."""
        self.n += 1
        df.write.parquet(f"{self.base}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{self.n}")

    @contextmanager
    def bucketed(self, df: DataFrame, key: str) -> Iterator[DataFrame]:
        """``df`` in buckets of ``key`` while the block lasts: joins on it leave these rows where they are."""
        self.n += 1
        name, n = f"codelake_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, key).write.bucketBy(n, key).option("path", f"{self.base}/{self.n}").saveAsTable(name, format="parquet")
        try:
            yield self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def result(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}-result"
        df.write.parquet(path)
        _RESULTS.append(path)
        delete(self.spark, self.base)
        return self.spark.read.schema(df.schema).parquet(path)
