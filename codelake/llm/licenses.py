"""License notices: exact phrases, and near ones by seeds and bounded-error matching.

A notice of n characters with at most k edits keeps at least one of k + 1 pieces of it
unchanged (pigeonhole). The pieces are searched exactly, which is a fast scan of the whole
text; from each word that a piece puts at the start of a notice, the ``regex`` library matches the
notice with up to k insertions, deletions or substitutions up to a word's end, and reports the span.
Ends that no k edits reach are passed over, by the edit distances of the stretch, and equal
stretches are matched once, so that a text full of seeds takes linear time. Texts are matched as
words joined by single spaces, so punctuation and line breaks are no edits.

Edits are counted in characters: a text is matched with one byte for each code point (see
:func:`one_byte`), as letters that occur in no notice need not be told apart.

Of the stretches that match a notice, those with the fewest edits come first, then the
first in the text, then the shortest; one that overlaps an earlier choice is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import alnum_words

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Short notices, their labels and the edits allowed in each.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("apache license version", "apache", 2),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution", "cc-by", 3),
    ("creative commons zero", "cc0", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("all rights reserved", "proprietary", 1),
]
SPANS = "array<struct<label:string,first_word:bigint,n_words:bigint,edits:int,matched:string>>"


def one_byte(text: str, letters: str = "") -> bytes:
    """One byte for each code point: ASCII as it is, the i-th of the sorted ``letters`` as 128 + i, any other as ``?``."""
    if not letters or text.isascii():
        return text.encode("ascii", "replace")
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    known = np.array([ord(c) for c in letters], "<u4")
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return np.where(code < 128, code, np.where(known[at] == code, 128 + at, ord("?"))).astype(np.uint8).tobytes()


def pieces(notice: str, edits: int, letters: str = "") -> list[bytes]:
    """``edits`` + 1 pieces of nearly equal length that make up the notice."""
    n, k = len(notice), edits + 1
    ends = [i * n // k for i in range(k + 1)]
    return [one_byte(notice[a:b], letters) for a, b in zip(ends, ends[1:], strict=False)]


def ends_within(notice: bytes, window: bytes, edits: int) -> list[int]:
    """Ends of words of ``window`` up to which it is within ``edits`` of ``notice``; bit-parallel
    columns of the edit distance table."""
    masks: dict[int, int] = {}
    for i, c in enumerate(notice):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << len(notice)) - 1, 1 << len(notice) - 1
    up, down, score, out = full, 0, len(notice), []
    for j, c in enumerate(window):
        if c == 0x20 and score <= edits:
            out.append(j)
        eq = masks.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(zero | up)), up & zero
        score += 1 if plus & last else -1 if minus & last else 0
        plus, minus = plus << 1 & full | 1, minus << 1 & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
    if score <= edits:
        out.append(len(window))
    return out


class Notice:
    """A notice: its seeds, and the stretches from a given place that match it."""

    MEMORY = 20_000

    def __init__(self, phrase: str, label: str, edits: int, letters: str = ""):
        self.phrase, self.label, self.edits, self.parts = one_byte(phrase, letters), label, edits, pieces(phrase, edits, letters)
        self.pattern = regex.compile(b"(?b)(?:%b){e<=%d}" % (regex.escape(self.phrase), edits))
        self.known: dict[bytes, list[tuple[int, int]]] = {}

    def starts(self, flat: bytes) -> set[int]:
        """Starts of words from which a stretch can match: a piece of it stands where it must, give
        or take the edits."""
        out: set[int] = set()
        offset = 1  # the blank before the word
        for part in self.parts:
            at = flat.find(part)
            while at >= 0:
                lo, hi = max(0, at - offset - self.edits), at - offset + self.edits + 1
                blank = flat.find(b" ", lo, hi)
                while blank >= 0:
                    out.add(blank + 1)
                    blank = flat.find(b" ", blank + 1, hi)
                at = flat.find(part, at + 1)
            offset += len(part)
        return out

    def matches(self, flat: bytes, start: int) -> list[tuple[int, int]]:
        """(length, edits) of each stretch of whole words from ``start`` that the pattern matches."""
        window = flat[start : start + len(self.phrase) + self.edits + 1]
        window = window[: window.rfind(b" ")]
        found = self.known.get(window)
        if found is None:
            whole = ((end, self.pattern.fullmatch(window, 0, end)) for end in ends_within(self.phrase, window, self.edits))
            found = [(end, sum(m.fuzzy_counts)) for end, m in whole if m]
            if len(self.known) >= self.MEMORY:
                self.known.clear()
            self.known[window] = found
        return found


class Scanner:
    """Compiled notices; ``scan`` gives the exact and the near places in a text."""

    def __init__(self, base: dict[str, str], notices: list[tuple[str, str, int]]):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.letters = "".join(sorted({c for phrase, _, _ in notices for c in phrase if ord(c) > 127}))
        if len(self.letters) > 128:
            raise ValueError("notices with more than 128 different letters outside ASCII: scan them in several calls")
        self.notices = [Notice(*n, self.letters) for n in notices]

    def scan(self, text: str | None):
        """(number of words, exact places [(word, label)], near spans [(label, word, words, edits, text)])."""
        words = alnum_words(text)
        flat = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in self.base:
            at = flat.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = flat.find(phrase, at + 1)
        exact, word, upto = [], -1, 0
        for at, label in sorted(found):  # counted on from place to place
            word, upto = word + flat.count(b" ", upto, at + 1), at + 1
            exact.append((word, label))
        near: set[tuple[int, str, int, int, str]] = set()
        blanks, whole = None, flat.decode("utf-8", "replace")
        flat = one_byte(whole, self.letters)  # from here, places are code points
        for notice in self.notices:
            options = [(edits, s, s + n) for s in notice.starts(flat) for n, edits in notice.matches(flat, s)]
            if not options:
                continue
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
            options.sort()
            first = np.searchsorted(blanks, [s - 1 for _, s, _ in options]).tolist()
            upto = np.searchsorted(blanks, [e for _, _, e in options]).tolist()
            taken = bytearray(len(words))
            for (edits, s, e), a, b in zip(options, first, upto, strict=True):
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    near.add((a, notice.label, b - a, edits, whole[s:e]))
        spans = [(label, w, n, e, t) for w, label, n, e, t in sorted(near)]
        return len(words), sorted(exact), spans


def license_spans(docs: DataFrame, base: dict[str, str] | None = None, notices: list[tuple[str, str, int]] | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: ``carry``, n_words, exact and near.

    exact: array of (label, first_word, ...) for each place where the words of a base phrase
    stand one after another; near: the same for notices within their number of edits (of
    characters, in any script), with the edits and the matched text; spans of one notice don't overlap. Words count from 0.

    Null or empty text: no words, empty arrays. Equal places of two notices: one span for each
    label. Repeated rows: equal results. No rows: none. Further columns are ignored."""
    scanner = (BASE if base is None else base, NOTICES if notices is None else notices)
    schema = docs.select(*carry).withColumns({"n_words": F.lit(0).cast("long"), "exact": F.lit(None).cast(SPANS), "near": F.lit(None).cast(SPANS)}).schema
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())]))
    length = {label: len(p.split()) for p, label in scanner[0].items()}
    phrase = {label: p for p, label in scanner[0].items()}

    def run(batches):
        own = Scanner(*scanner)
        keys = ("label", "first_word", "n_words", "edits", "matched")
        for b in batches:
            n, exact, near = [], [], []
            for t in b.column(b.num_columns - 1):
                words, base_hits, spans = own.scan(t.as_py())
                n.append(words)
                exact.append([dict(zip(keys, (x, w, length[x], 0, phrase[x]), strict=True)) for w, x in base_hits])
                near.append([dict(zip(keys, s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(exact, kind), pa.array(near, kind)], names=[*carry, "n_words", "exact", "near"])

    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base: places of base phrases; first_word and last_word: their smallest and largest start
    (null: none); base_labels and labels (the near ones too): distinct, sorted, comma-joined,
    empty if there are none; score: 1 for an exact place, else 1 less the smallest share of
    edited characters, 0 without any. Edge cases: see :func:`license_spans`."""
    rows = license_spans(docs, **options)
    start = F.transform("exact", lambda s: s["first_word"])
    names = lambda spans: F.transform(spans, lambda s: s["label"])
    share = F.array_max(F.transform("near", lambda s: 1 - s["edits"] / F.greatest(F.length(s["matched"]), F.lit(1))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names(F.col("exact")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names(F.col("exact")), names(F.col("near"))))), ",").alias("labels"),
        F.when(F.size("exact") > 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))).alias("score"),
        "near",
    )
