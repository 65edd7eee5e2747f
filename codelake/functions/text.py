"""String functions on columns; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EOL = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(_SPACE))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True if the string contains one of the words; a chain of conditions, no join."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def text_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def content_key(language: Column, code: Column) -> Column:
    """``language:sha256`` of a piece of code."""
    return F.concat(language, F.lit(":"), text_hash(code))


def cache_key(language: Column, text: Column) -> Column:
    """MD5 of ``language:text``."""
    return F.md5(F.concat(language, F.lit(":"), text).cast("binary"))


def escape_label(c: Column, width: int = 80) -> Column:
    """A diagram label: quotes escaped, line breaks and tabs to spaces, white space collapsed, cut."""
    one = F.translate(F.replace(c, F.lit('"'), F.lit('\\"')), "\r\n\t", "   ")
    return F.substring(strip(F.regexp_replace(one, r"\s{2,}", " ")), 1, width)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape_html(c: Column) -> Column:
    """All named and numeric entities; these are many, so the Python library does it in batches."""
    import html

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else html.unescape(t))

    return run(c)


def truncate(c: Column, width: int, suffix: str = "...") -> Column:
    """At most ``width`` characters, the last ones ``suffix`` if something was cut. A width
    under the suffix's length cuts that many characters from the end, as a negative slice does."""
    head = width - len(suffix)
    kept = F.substring(c, F.lit(1), F.length(c) + head) if head < 0 else F.substring(c, 1, head)
    return F.when(F.length(c) > width, F.concat(kept, F.lit(suffix))).otherwise(c)


def normalize_whitespace(c: Column) -> Column:
    """Runs of blanks to one space, runs of blank lines to one line, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def indent_lines(c: Column, spaces: int = 2) -> Column:
    """Every line indented; blank lines become empty."""
    pad = " " * spaces
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(strip(x) == "", F.lit("")).otherwise(F.concat(F.lit(pad), x))), "\n")


def strip_code_markers(c: Column) -> Column:
    """Without the lines that open and close a fenced code block."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?m)^```[\w+-]*[ \t]*\n?", ""), r"(?m)\n?```[ \t]*$", ""))


def sanitize_filename(c: Column, filler: str = "_") -> Column:
    """Letters, digits, ``._-``; anything else is ``filler``, runs of which collapse."""
    import re

    safe = F.regexp_replace(c, r"[^A-Za-z0-9._-]+", filler)
    return F.btrim(F.regexp_replace(safe, f"(?:{re.escape(filler)})+", filler), F.lit(filler)) if filler else safe


def safe_output_name(c: Column) -> Column:
    """ASCII letters, digits, space, ``-`` and ``_`` stay; ends stripped, spaces to ``_``."""
    return F.replace(strip(F.regexp_replace(c, r"[^A-Za-z0-9 _-]", "")), F.lit(" "), F.lit("_"))


def count_lines(c: Column) -> Column:
    """Lines as ``str.splitlines`` counts them: no extra one after a final line end."""
    body = F.regexp_replace(c, f"(?:{EOL})\\z", "")
    return F.when(c == "", 0).otherwise(F.size(F.split(body, EOL)))


def ensure_newline_ending(c: Column) -> Column:
    """Exactly one line end at the end; the empty string stays."""
    return F.when(c == "", c).otherwise(F.concat(F.rtrim(c, F.lit("\n")), F.lit("\n")))


def sanitize_code(c: Column, most: int = 50_000, compat: bool = False) -> Column:
    """Code for a prompt: commands to the model, substitutions and unprintable characters go.

    By default the patterns mean what they are for and lines keep their indentation. ``compat``
    uses the literal patterns of the source tool (most of which never match) and strips lines."""
    if compat:
        patterns = [r"\\b(ignore|reset)\\b", r"(system|assistant|user)\\s*:", r"<<\\|.*?>>", r"`[^`]*`[^`]*`", r"\\$\{.*?\}", r"\\$\(.*?\)"]
    else:
        patterns = [r"(?i)\b(ignore|reset)\b", r"(?i)\b(system|assistant|user)\s*:", r"<<\|?.*?>>", r"```", r"\$\{[^}]*\}", r"\$\([^)]*\)"]
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    c = F.regexp_replace(c, r"[^\P{C}\n\t]", "")
    c = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n... [truncated]"))).otherwise(c)
    clean = (lambda x: strip(x)) if compat else (lambda x: F.rtrim(x, F.lit(_SPACE)))
    return F.array_join(F.transform(F.split(c, "\n"), clean), "\n")


def lenient_json(raw: Column, schema: str) -> Column:
    """A struct from text that should be JSON: the whole text, else from its first ``{`` to its
    last ``}``, else a struct with the first 280 characters in ``summary`` (null if there is none)."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    valid = lambda c: F.try_parse_json(c).isNotNull() & F.get_json_object(c, "$").isNotNull() & F.startswith(F.ltrim(c), F.lit("{"))
    fallback = F.to_json(F.struct(F.substring(strip(raw), 1, 280).alias("summary")))
    return F.from_json(F.when(valid(raw), raw).when(valid(inner), inner).otherwise(fallback), schema)
