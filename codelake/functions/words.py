"""Word tables of any size against columns.

Small tables are chains of conditions in the JVM. A chain grows with the table, so beyond ``CHAIN``
words a table becomes one automaton (Aho-Corasick), which finds all of its words in a single pass over
a text; it is built once for a worker process and run over Arrow batches. Both give the same results.
Words are contained as plain text, anywhere and overlapping; an empty word is in every text; a null text
gives null.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

CHAIN = 64


@functools.lru_cache(maxsize=8)
def _finder(words: tuple[str, ...]):
    """``text -> set of numbers of the words in it``."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    always = frozenset(places.pop("", []))
    if not places:
        return lambda text: set(always)
    automaton = ahocorasick.Automaton()
    for w, at in places.items():
        automaton.add_word(w, tuple(at))
    automaton.make_automaton()
    return lambda text: always.union(*(at for _, at in automaton.iter(text)))


def found(c: Column, words: Sequence[str], chain: int = CHAIN) -> Column:
    """The sorted numbers (from 0) of the words that the text contains; repeated words count each."""
    table = tuple(words)
    if len(table) <= chain:
        hits = F.array_compact(F.array(*[F.when(F.contains(c, F.lit(w)), F.lit(i)) for i, w in enumerate(table)])) if table else F.array().cast("array<int>")
        return F.when(c.isNotNull(), hits)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        find = _finder(table)
        return texts.map(lambda t: None if t is None else sorted(find(t)))

    return run(c)


def mentions(c: Column, words: Sequence[str], chain: int = CHAIN) -> Column:
    """True if the text contains one of the words."""
    return contains_any(c, words) if len(words) <= chain else F.size(found(c, words, chain)) > 0


def mentioning(c: Column, words: Sequence[str], chain: int = CHAIN) -> Column:
    """The elements of an array of strings whose lower-case form contains one of the words, in order."""
    if len(words) <= chain:
        return F.filter(c, lambda x: contains_any(F.lower(x), words))
    table = tuple(words)

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series, lowered: pd.Series) -> pd.Series:
        find = _finder(table)
        kept = [None if r is None else [x for x, low in zip(r, small, strict=True) if low is not None and find(low)] for r, small in zip(rows, lowered, strict=True)]
        return pd.Series(kept, index=rows.index, dtype=object)

    return run(c, F.transform(c, F.lower))
