"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there: the files outlive a lost executor, are
written once (``Dataset.checkpoint`` would compute its input twice and store it
uncompressed) and keep column pruning for later readers.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession



class _Tables(threading.local):
    """What a thread has written; threads don't release each other's tables."""

    def __init__(self):
        self.paths: list[str] = []


_LIVE = _Tables()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):  # local-cluster has machines of its own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="codelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back.

    ``rows_per_file`` bounds what a reader takes at a time, where rows are large. Loops over small tables pass ``uncompressed``: a codec's native buffers are only freed as the
    JVM collects garbage, and thousands of small files would pile them up."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codelake-{tag}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, maxRecordsPerFile=rows_per_file).parquet(path)
    _LIVE.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A position to pass to :func:`release`."""
    return len(_LIVE.paths)


def release(spark: SparkSession, start: int = 0, end: int | None = None) -> None:
    """Delete the tables written between two marks; their readers must have ended."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _LIVE.paths[start:end]:
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    stop = len(_LIVE.paths) if end is None else end
    _LIVE.paths[start:stop] = [""] * (stop - start)
