"""Rewriting and checking of generated Markdown, on a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import contains_any

DIAGRAM_MARKS = {"architecture": "[Architecture Diagram]", "folder_structure": "[Folder Structure]", "dependencies": "[Dependency Diagram]", "data_flow": "[Data Flow]"}


def drop_lines(text: Column, words: list[str] = tables.DROPPED_LINES) -> Column:
    """Without the lines that contain one of the words."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~contains_any(x, words)), "\n")


def drop_windows_paths(text: Column) -> Column:
    return F.regexp_replace(text, r"""[A-Z]:[\\/][^"'\s\]]+""", "")


def fix_port(text: Column) -> Column:
    """A slash between ``host:port`` and a path that follows at once."""
    return F.regexp_replace(text, r"(https?://[A-Za-z0-9.-]+:\d+)([A-Za-z])", "$1/$2")


def split_host(text: Column) -> Column:
    """A slash before the last letter of a host. This is what the source tool does; it spoils good
    addresses, so it is no part of :func:`post_process`."""
    return F.regexp_replace(text, r"(https?://[A-Za-z0-9.-]+)([A-Za-z][A-Za-z0-9-]*)", "$1/$2")


def fix_separators(text: Column, compat: bool = False) -> Column:
    """``srcindex`` to ``src/index``: a known directory that runs into a known file name, or with
    ``compat`` into any letter."""
    follows = "[a-z]" if compat else "(?:" + "|".join(tables.SPLIT_FILES) + r")\b"
    return F.regexp_replace(text, r"\b(" + "|".join(tables.SPLIT_DIRS) + f")({follows})", "$1/$2")


def splice_diagrams(text: Column, diagrams: dict[str, Column]) -> Column:
    """Diagrams in place of their marks; the architecture falls back on its heading."""
    for name, mark in DIAGRAM_MARKS.items():
        if name not in diagrams:
            continue
        d = F.coalesce(diagrams[name], F.lit(""))
        put = F.replace(text, F.lit(mark), F.concat(F.lit("\n"), d, F.lit("\n")))
        if name == "architecture":
            at = F.locate("## Architecture", text)
            end = at + len("## Architecture")
            headed = F.concat(F.substring(text, F.lit(1), end - 1), F.lit("\n\n"), d, F.lit("\n"), F.substring(text, end, F.length(text)))
            text = F.when(d == "", text).when(F.contains(text, F.lit(mark)), put).when(at > 0, headed).otherwise(text)
        else:
            text = F.when(d == "", text).otherwise(put)
    return text


def drop_marks(text: Column) -> Column:
    """Without diagram marks and placeholders that are left."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\[[\w\s]+Diagram\]", ""), r"(?iU)\[[\w\s]+placeholder[^\]]*\]", "")


def dedup_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: Column | None = None) -> DataFrame:
    """``key`` and ``text`` without sections whose heading occurred before in the document.

    A repeated heading line goes, and what follows it until the next new heading. ``heading``: a
    condition on the column ``line`` (default: it starts with ``##``). Documents are dealt by key
    once, before their lines are made; both windows and the aggregate keep that partitioning."""
    heading = F.startswith("line", F.lit("##")) if heading is None else heading
    dealt = docs.select(key, text).repartition(key)
    lines = dealt.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("h", heading)
    nth = F.row_number().over(Window.partitionBy(key, "line", "h").orderBy("pos"))
    lines = lines.withColumn("keep", F.when(F.col("h"), nth == 1))
    state = F.coalesce(F.last("keep", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(True))
    kept = lines.withColumn("keep", state).filter("keep")
    out = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return out.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias(text))


def footer(at: Column | None = None) -> Column:
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.lit("\n\n---\n\n*This README was automatically generated on "), stamp, F.lit("*\n"))


def issues(text: Column) -> Column:
    """What a check of the text finds, as an array of sentences."""
    n = lambda p, s=None: F.regexp_count(text if s is None else s, F.lit(p))
    low = F.lower(text)
    said = lambda count, words: F.when(count > 0, F.concat(F.lit("Contains "), count.cast("string"), F.lit(f" {words}")))
    paths = n(r"[A-Z]:[\\/]\S+")
    urls = n(r"https?://[^/\s:]+:\d+[a-zA-Z]")
    merged = n(r"\b(src|app|lib)(index|main|app|server|routes|models)")
    ends = F.when(contains_any(low, ["curl", "endpoint"]), n(r"`(GET|POST|PUT|DELETE|PATCH)\s+([a-z])")).otherwise(0)
    names = [F.when(F.contains(low, F.lit(p)), F.lit(f"Contains placeholder text: {p}")) for p in tables.PLACEHOLDERS]
    return F.array_compact(F.array(said(paths, "absolute Windows paths"), said(urls, "malformed URLs (missing slash)"), *names, said(merged, "paths with missing separators"), said(ends, "endpoints without leading slash")))


def suspicious_urls(text: Column) -> Column:
    """Addresses whose host ends in a letter, to look at."""
    return F.regexp_extract_all(text, F.lit(r"(https?://[^/\s]+[a-zA-Z])"), F.lit(1))


def post_process(docs: DataFrame, key: str = "doc_id", text: str = "text", diagrams: dict[str, Column] | None = None, stamp: Column | None = None) -> DataFrame:
    """All rewrites in order, then ``issues`` of the result and the footer."""
    c = fix_separators(fix_port(drop_windows_paths(drop_lines(F.col(text)))))
    c = drop_marks(splice_diagrams(c, diagrams or {}))
    out = dedup_sections(docs.select(key, c.alias(text)), key, text)
    return out.select(key, F.concat(F.col(text), footer(stamp)).alias(text), issues(F.col(text)).alias("issues"))
