"""Source files of any file system, listed and read in the tasks.

Folders are listed by the tasks in rounds: a task lists up to ``folders`` folders below those that it
was given and hands the rest on, so a tree of a few thousand folders takes one round and a large one is
spread over all cores. The driver sees counts only. Names of any beginning are listed, also
``_`` and ``.``, which Spark's file sources skip.

``content`` is a column of a deterministic function of the path. So the optimizer moves filters on
path, language and length in front of it, down to the scan of the listing, and drops it
where it isn't selected: no byte of a file that a query doesn't need is read.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.tables import LEFT_OUT, PRUNED, PRUNED_MORE
from ..operators.numbering import numbered
from ..operators.scratch import Scratch
from .tree import MOST, decode, wanted

LISTED = "path string, language string, length bigint, is_folder boolean, error string"
_LISTED = pa.schema([("path", pa.string()), ("language", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_()), ("error", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before such paths in an address)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    address = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(address)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"


def _children(folder: str, pruned: list[str], left_out: list[str]) -> Iterator[tuple]:
    """LISTED rows of the wanted files and the subfolders of a folder; one row with an error if it can't be listed."""
    try:
        system, inner, before = opened(folder)
        local = isinstance(system, fs.LocalFileSystem)
        entries = system.get_file_info(fs.FileSelector(inner))
    except (OSError, ValueError) as e:
        yield folder, None, None, False, f"{type(e).__name__}: {e}"[:300]
        return
    for x in entries:
        if x.type == fs.FileType.Directory:
            if x.base_name not in pruned and not (local and os.path.islink(x.path)):  # linked folders may lead back
                yield before + x.path, None, None, True, None
        elif x.type == fs.FileType.File and (lang := wanted(x.base_name, left_out)):
            yield before + x.path, lang, x.size, False, None


def _list(pruned: list[str], left_out: list[str], folders: int):
    def run(batches):
        for b in batches:
            for start in b.column(0).to_pylist():
                held, todo, seen = [], deque([start]), 0
                while todo and seen < folders:
                    seen += 1
                    for row in _children(todo.popleft(), pruned, left_out):
                        if row[3]:
                            todo.append(row[0])
                        else:
                            held.append(row)
                        if len(held) == 8192:
                            yield _batch(held)
                            held = []
                yield _batch(held + [(path, None, None, True, None) for path in todo])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_LISTED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTED, strict=True)], schema=_LISTED)


def listing(spark: SparkSession, *roots: str, prune: list[str] | None = None, leave_out: list[str] | None = None, folders: int = 1000, max_rounds: int = 10_000) -> DataFrame:
    """path, language, length, error: the files to analyse below the roots, each once.

    Roots are folders: plain local paths or addresses that ``pyarrow.fs`` opens (file, hdfs, s3, s3a,
    gs, ...). A folder that can't be listed, or that isn't there, is a row with an error; linked folders
    are left out on local file systems. One folder is listed by one task."""
    s = Scratch(spark)
    run = _list(PRUNED + PRUNED_MORE if prune is None else prune, LEFT_OUT if leave_out is None else leave_out, folders)
    front, found = spark.createDataFrame([(r.rstrip("/") or "/",) for r in dict.fromkeys(roots)], "path string"), None
    width = max(spark.sparkContext.defaultParallelism, 1)
    for _ in range(max_rounds):
        # more folders than cores are dealt at random, so that a deep folder's children don't stay together
        step = s.cut(front.repartition(width, F.xxhash64("path")).mapInArrow(run, LISTED))
        files = step.filter("not is_folder").drop("is_folder")
        found = files if found is None else found.unionByName(files)
        front = step.filter("is_folder").select("path").distinct()
        if not step.filter("is_folder").take(1):
            return s.result(found.distinct())
    raise RuntimeError(f"folders are nested more than {max_rounds} rounds deep")


@F.pandas_udf(StringType())
def _content(path):
    def one(p):
        try:
            system, inner, _ = opened(p)
            with system.open_input_stream(inner, compression=None) as f:
                return decode(f.read())
        except (OSError, ValueError):
            return None

    return path.map(one)


def with_content(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` (UTF-8, else Latin-1; null for a file that can't be read any more)."""
    return files.withColumn("content", _content("path"))


def scan(spark: SparkSession, *roots: str, most: int = MOST, chunk: int = 64 << 20, **options) -> DataFrame:
    """path, file_ord, language, length, content of the files to analyse, as ``read_tree`` gives them.

    Files of more than ``most`` bytes are left out. ``file_ord`` is the place of a file in the order of all
    listed paths. Files are dealt to tasks by bytes: a task holds files of ``chunk`` bytes and one more file
    at most, and so does a batch. The listing is taken when this is called, contents when rows are read;
    no files: no rows. ``options``: see :func:`listing`."""
    listed = listing(spark, *roots, **options).filter(F.col("length") <= most).select("path", "language", "length", (F.col("length") + 4096).alias("cost"))
    ordered = numbered(listed, ["path"], "file_ord", weight="cost")
    dealt = Scratch(spark).result(ordered.select("path", "file_ord", "language", "length", F.floor(F.col("cost_before") / chunk).cast("int").alias("_chunk")))
    chunks = (dealt.agg(F.max("_chunk")).first()[0] or 0) + 1
    return with_content(dealt.repartitionById(chunks, F.col("_chunk")).select("path", "file_ord", "language", "length"))
