"""Source files as a DataFrame.

Spark's file sources skip names that start with ``_`` or ``.``, so ``__init__.py`` would be
lost. The ``source_tree`` data source walks the folders on the driver (names and sizes only,
pruned on the way), deals the paths out by size, and reads them in the tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.tables import CONFIG_EXAMPLES, CONFIG_FILES, LEFT_OUT, PRUNED, PRUNED_MORE, SCANNED

FILE = "path string, file_ord int, language string, length bigint, content string"
MOST = 10 * 1024 * 1024


def language(path: Column) -> Column:
    """The analysed language of a path; null for other files."""
    out = F.lit(None).cast("string")
    for suffix, name in reversed(SCANNED):
        out = F.when(F.endswith(path, F.lit(suffix)), name).otherwise(out)
    return out


def wanted(name: str, left_out: list[str]) -> str | None:
    """The language of a file name that the scan takes."""
    if any(w in name.lower() for w in left_out):
        return None
    return next((lang for suffix, lang in SCANNED if name.endswith(suffix)), None)


def walk(root: str, pruned: list[str], left_out: list[str]) -> list[tuple[str, str, int]]:
    """(path, language, bytes) of all files to analyse, sorted by path."""
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in pruned]
        for name in names:
            lang = wanted(name, left_out)
            if lang:
                path = os.path.join(folder, name)
                try:
                    out.append((path, lang, os.path.getsize(path)))
                except OSError:
                    continue
    return sorted(out)


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


class _Chunk(InputPartition):
    def __init__(self, files: list[tuple[int, str, str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path") or ""
        self.pruned = [x for x in options.get("prune", ",".join(PRUNED + PRUNED_MORE)).split(",") if x]
        self.left_out = [x for x in options.get("leaveout", ",".join(LEFT_OUT)).split(",") if x]
        self.chunk = int(options.get("chunkbytes", 8 * 1024 * 1024))
        self.most = int(options.get("maxbytes", MOST))

    def partitions(self) -> list[InputPartition]:
        chunks, held, size = [], [], 0
        for i, (path, lang, n) in enumerate(walk(self.root, self.pruned, self.left_out)):
            if n > self.most:
                continue
            held.append((i, path, lang, n))
            size += n + 4096
            if size >= self.chunk:
                chunks.append(_Chunk(held))
                held, size = [], 0
        return [*chunks, _Chunk(held)] if held or not chunks else chunks

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("file_ord", pa.int32()), ("language", pa.string()), ("length", pa.int64()), ("content", pa.string())])
        for lo in range(0, len(partition.files), 64):
            rows = []
            for i, path, lang, n in partition.files[lo : lo + 64]:
                try:
                    with open(path, "rb") as f:
                        rows.append((path, i, lang, n, decode(f.read())))
                except OSError:
                    continue
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], schema=kinds)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(folder)``. Options: prune and leaveout (comma
    lists), maxbytes (larger files are skipped), chunkbytes (bytes for a task)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """The analysed files of a folder."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**options).load(root)


def decoded(files: DataFrame, most: int = MOST) -> DataFrame:
    """``binaryFile`` rows (path, length, content) as FILE rows. The size filter stands before the
    content is touched, so it reaches the scan; bytes that are no UTF-8 are taken as Latin-1."""
    kept = files.filter(F.col("length") <= most)
    text = F.col("content").cast("string")
    out = kept.select("path", language(F.col("path")).alias("language"), "length", F.when(F.is_valid_utf8(text), text).otherwise(F.decode("content", "ISO-8859-1")).alias("content"))
    return out.filter("language is not null")


def config_files(spark: SparkSession, root: str) -> DataFrame:
    """ord, file, description of the known configuration files in the root, in table order."""
    found = [(i, f, d) for i, (f, d) in enumerate(CONFIG_FILES) if os.path.exists(os.path.join(root, f))]
    return spark.createDataFrame(found, "ord int, file string, description string")


def config_examples(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """ord, title, description, code, language: the beginnings of known configuration files."""
    rows = []
    for i, (name, lang) in enumerate(CONFIG_EXAMPLES):
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                rows.append((i, f"Configuration: {name}", f"Configuration settings from {name}", decode(f.read()), lang))
    out = spark.createDataFrame(rows, "ord int, title string, description string, code string, language string")
    cut = F.concat(F.substring("code", 1, most), F.lit("\n# ... (truncated)"))
    return out.withColumn("code", F.when(F.length("code") > most, cut).otherwise(F.col("code")))
