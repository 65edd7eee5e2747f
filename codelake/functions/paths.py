"""Path functions on columns, and the driver's guard of paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import DIAGRAM_LANGUAGES


def normalize(path: Column) -> Column:
    """Slashes for backslashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_drive(path: Column) -> Column:
    return F.regexp_replace(normalize(path), r"^[A-Za-z]:/", "")


def segments(path: Column) -> Column:
    """Non-empty parts of the path, without a drive."""
    return F.filter(F.split(strip_drive(path), "/"), lambda s: s != "")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(normalize(path), "/"), -1)


def directory_of(path: Column) -> Column:
    """All but the last part; empty for a bare name."""
    return F.regexp_replace(normalize(path), r"/?[^/]*$", "")


def tail(path: Column, parts: int) -> Column:
    """The last ``parts`` parts, joined."""
    s = segments(path)
    return F.array_join(F.slice(s, F.greatest(F.size(s) - parts + 1, F.lit(1)), F.lit(parts)), "/")


def short_path(path: Column, keep: int = 3) -> Column:
    """The last parts, after ``.../`` if some were cut; ``(unknown)`` for no path."""
    s = segments(path)
    return F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, "(unknown)").when(F.size(s) <= keep, F.array_join(s, "/")).otherwise(F.concat(F.lit(".../"), tail(path, keep)))


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; unchanged outside."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def relative_segments(path: Column, prefix: Column) -> Column:
    """The parts after a common prefix (array); all parts if it is none of the path's."""
    s = segments(path)
    own = F.array_join(F.slice(s, F.lit(1), F.size(prefix)), "/") == F.array_join(prefix, "/")
    return F.when(own, F.slice(s, F.size(prefix) + 1, F.size(s))).otherwise(s)


def short_relative_label(parts: Column, keep: int = 3) -> Column:
    """``(root)`` for no parts, else the last ``keep`` of them."""
    n = F.size(parts)
    return F.when(n == 0, "(root)").when(n <= keep, F.array_join(parts, "/")).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, n - keep + 1, F.lit(keep)), "/")))


def anchor(path: Column) -> Column:
    """A lower-cased anchor: everything but letters and digits becomes one dash."""
    return F.btrim(F.lower(F.regexp_replace(normalize(path), r"[^A-Za-z0-9]+", "-")), F.lit("-"))


def safe_id(*parts: Column) -> Column:
    """A diagram node id from the parts: letters, digits and underscores."""
    return F.regexp_replace(F.concat_ws("_", *parts), r"[^A-Za-z0-9_]", "_")


def language_of(path: Column, table: Iterable[tuple[str, str]] = DIAGRAM_LANGUAGES, other: str | None = "Other") -> Column:
    """The language of the first suffix that fits."""
    low, out = F.lower(path), F.lit(other)
    for suffix, language in reversed(list(table)):
        out = F.when(F.endswith(low, F.lit(suffix)), language).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob that must match the end of the path, part by part."""
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern.replace("\\", "/"))
    return f"^{out}$" if pattern.startswith("/") else f"(^|/){out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    return F.rlike(normalize(path), F.lit(glob_regex(pattern))) if pattern else F.lit(False)


def matches_regex(path: Column, pattern: str) -> Column:
    """False for a pattern that is none."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.rlike(normalize(path), F.lit(pattern))


def climbs(path: Column) -> Column:
    """True if the path tries to leave its folder, also percent-encoded."""
    low = F.lower(path)
    return F.contains(low, F.lit("..")) | F.contains(low, F.lit("%2e%2e"))


def ancestors(path: Column) -> Column:
    """All directories above the file, shortest first, as paths."""
    s = segments(path)
    return F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def common_prefix(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row: ``prefix`` (array) of the parts that all directories share from the start on.

    A part counts at its position only if all paths have it there; gaps end the prefix. A single
    aggregation by position, so one task sees one row for each distinct part at most."""
    # position 0 is an empty part that every path has, so its count is the number of paths
    dirs = paths.select(F.concat(F.array(F.lit("")), segments(directory_of(F.col(column)))).alias("s"))
    at = dirs.select(F.posexplode("s").alias("pos", "part")).groupBy("pos").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count(F.lit(1)).alias("have"))
    found = at.filter("a = b").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "have"))).alias("found"))
    good = F.filter("found", lambda x, i: (x["pos"] == i) & (x["have"] == F.col("found")[0]["have"]) & (i > 0))
    return found.select(F.transform(good, lambda x: x["a"]).alias("prefix"))


def safe_project_path(path: str, forbidden: Iterable[str] = ("/etc", "/sys", "/proc", "/root", "/boot", "/dev")) -> tuple[bool, str]:
    """(True, real path) if a project may be read from here, else (False, reason). Driver side."""
    if ".." in path or "%2e%2e" in path.lower():
        return False, "the path climbs"
    if not os.path.isdir(path):
        return False, "no such folder"
    real = os.path.realpath(path)
    for bad in forbidden:
        base = os.path.realpath(bad)
        if real == base or real.startswith(base.rstrip("/") + "/"):
            return False, f"{bad} is not open to scans"
    return True, real
