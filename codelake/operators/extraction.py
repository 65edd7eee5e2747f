"""Files to fact tables: one pass of parsing, then one projection for each table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.extract import PARSERS
from ..sources.extract.records import CLASS_FIELDS, IMPORT_FIELDS, SYMBOL_FIELDS, VARIABLE_FIELDS

_STRUCT = lambda fields: "array<struct<" + ", ".join(": ".join(f.split(" ", 1)) for f in fields.split(", ")) + ">>"
PARSED = (
    "path string, file_ord int, language string, summary string, n_lines int,"
    f" symbols {_STRUCT(SYMBOL_FIELDS)}, classes {_STRUCT(CLASS_FIELDS)}, imports {_STRUCT(IMPORT_FIELDS)}, variables {_STRUCT(VARIABLE_FIELDS)}, error string"
)


# Files, and characters of source, whose rows a task makes before it hands them on; characters of sources whose rows it keeps.
PIECE_FILES, PIECE_CHARS = 256, 4_000_000
KEPT_CHARS = 1_000_000


def _batches(batches: Iterable[pa.RecordBatch], parsers: dict[str, Callable[[str], dict]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a few files at a time. Files with the same source are parsed once while it is among those kept."""
    kept, kept_chars = {}, 0
    for b in batches:
        rows, chars = [], 0
        for k in range(b.num_rows):
            path, order, language, content = (b.column(i)[k].as_py() for i in range(4))
            size = len(content or "")
            found = kept.get((language, content))
            if found is None:
                try:
                    found = parsers[language](content or "")
                except Exception as e:  # a file that cannot be parsed is reported and hurts no other
                    found = {"error": f"{type(e).__name__}: {e}"[:300]}
                if kept_chars + size > KEPT_CHARS:
                    kept, kept_chars = {}, 0
                if size <= KEPT_CHARS:
                    kept[language, content] = found
                    kept_chars += size + 100  # a row without source takes room as well
            rows.append({"path": path, "file_ord": order, "language": language} | found)
            chars += size
            if len(rows) >= PIECE_FILES or chars >= PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows, chars = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def parse_files(files: DataFrame, parsers: dict[str, Callable[[str], dict]] | None = None) -> DataFrame:
    """``files(path, file_ord, language, content)`` parsed, one row each; ``error`` says why a
    file has none of the rest. Files of a language without a parser give an error row. A task holds
    the rows of a few files at a time, however many it is given. A parser must depend on the source alone."""
    parsers = dict(PARSERS if parsers is None else parsers)
    schema = StructType.fromDDL(PARSED)
    kinds = to_arrow_schema(schema)
    return files.select("path", "file_ord", "language", "content").mapInArrow(lambda batches: _batches(batches, parsers, kinds), schema)


def symbols(parsed: DataFrame) -> DataFrame:
    """path, file_ord, language and the fields of every function and method."""
    return parsed.select("path", "file_ord", F.col("language").alias("language_hint"), F.inline("symbols"))


def classes(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "file_ord", F.col("language").alias("language_hint"), F.inline("classes"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "file_ord", F.inline("imports"))


def variables(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "file_ord", F.inline("variables"))


def parameters(symbol_rows: DataFrame) -> DataFrame:
    """path, class_name, function, position and the fields of every parameter."""
    out = symbol_rows.select("path", "class_name", F.col("name").alias("function"), F.posexplode("parameters").alias("position", "p"))
    return out.select("path", "class_name", "function", "position", "p.*")


def diagnostics(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("path", F.lit("parse").alias("stage"), F.col("error").alias("message"))


def summaries(parsed: DataFrame) -> DataFrame:
    """One row a file that was parsed: path, file_ord, language, summary, and numbers of
    top-level functions, methods, classes and imports."""
    top = lambda s: F.size(F.filter("symbols", s))
    return parsed.filter("error is null").select(
        "path", "file_ord", "language", "summary", "n_lines",
        top(lambda s: s["class_name"].isNull()).alias("n_functions"),
        top(lambda s: s["class_name"].isNotNull()).alias("n_methods"),
        F.size("classes").alias("n_classes"),
        F.size("imports").alias("n_imports"),
    )
