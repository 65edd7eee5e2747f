"""Toxicity scores: boosted trees over a dozen dense features, isotonic calibration.

Features: densities of a lexicon (a short seed list, and words that the labelled sample ties
to label 1), hits near second-person words, hits that appear only once obfuscation is undone,
capitals, punctuation and obfuscation rates. The learned lexicon holds words and beginnings of
words (seven bytes), as languages that inflect and compound spread an insult over many forms. Documents are scored where they are read; only
the labelled sample, bounded by ``max_train`` rows, moves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, calibrate, fit_isotonic, fit_trees
from .words import ASCII_LOWER, UPPER, spaced_words

# Insults to start from, in English, German, French and Spanish.
SEED = """idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool jerk
bastard bitch asshole crap shit fuck hate ugly filthy vermin garbage retard imbecile
trottel arschloch dummkopf abschaum scheisse hurensohn widerlich wertlos
connard salaud imbécile abruti ordure merde idiote dégoûtant
imbécil estúpido idiota basura mierda cabrón asqueroso inútil""".split()
# Second-person words of the same languages.
SECOND = "you your yours yourself u ur youre du dich dir dein deine ihr euch tu toi te ton ta vous votre vos tú usted ustedes vosotros".split()
# Usual stand-ins for letters.
STAND_INS = bytes.maketrans(b"013457@$!|", b"oieastasil")

HEAD = 7
_EDGE = b".,;:!?\"'()[]{}<>*#%&$_-~/\\|@^+=`"
_MARKS = b"!?"
_SYMBOLS = b"*#%&$@_~^|+=<>"
FEATURES = ("seed", "seed_kinds", "learned", "learned_kinds", "weight", "strongest", "near_you", "you", "hidden", "capitals", "shouted", "marks", "symbols", "mixed", "log_words")


def held_out(doc_id: Column) -> Column:
    """True if crc32 of doc_id as text is 0 modulo 5; such labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees | None = None
    knots: tuple = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.where(x[:, 0] + x[:, 8] > 0, 0.9, 0.1)
        return calibrate(self.trees.margin(x), self.knots)


_SEED = frozenset(w.encode() for w in SEED)
_SECOND = frozenset(w.encode() for w in SECOND)
_JOINED = re.compile(rb"(?<![A-Za-z0-9])(?:[A-Za-z0-9@$!][.*_\- ]){2,}[A-Za-z0-9@$!](?![A-Za-z0-9])")
_MIXED = re.compile(rb"[A-Za-z][0-9@$*!|]+[A-Za-z]")


def units(kinds: set[bytes]) -> set[bytes]:
    """What the lexicon counts: the words, and the beginnings of longer ones with a star."""
    return kinds | {w[:HEAD] + b"*" for w in kinds if len(w) > HEAD}


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    """The values of FEATURES over the whole text; all 0 for null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.translate(ASCII_LOWER)
    words = [w.strip(_EDGE) for w in low.split()]
    n, size = max(len(words), 1), max(len(raw), 1)
    kinds = set(words)
    seeds, learned, you = kinds & _SEED, lexicon.keys() & units(kinds), kinds & _SECOND
    seed = sum(map(words.count, seeds)) if seeds else 0
    hits = [i for i, w in enumerate(words) if w in seeds or w in learned or w[:HEAD] + b"*" in learned] if seeds or learned else []
    near = 0
    if you and hits:
        at = np.array([i for i, w in enumerate(words) if w in you])
        right = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - hits), np.abs(at[np.maximum(right - 1, 0)] - hits))
        near = int((gap <= 5).sum())
    odd = [m.group() for m in _MIXED.finditer(raw)]
    hidden = 0
    if odd:
        for w in low.split():
            plain = w.strip(b".,;:?\"'()").translate(STAND_INS)
            if plain != w and (bare := plain.strip(_EDGE)) not in kinds and (bare in _SEED or bare in lexicon or (b"*" in w and _starred(w, lexicon))):
                hidden += 1
    for m in _JOINED.finditer(raw):
        bare = re.sub(rb"[.*_\- ]", b"", m.group().translate(ASCII_LOWER)).translate(STAND_INS)
        hidden += bare in _SEED or bare in lexicon
    count = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    capitals = count(UPPER)
    shouted = sum(1 for w in raw.split() if len(w) > 3 and w.isupper()) if capitals > 0.05 * size else 0
    return [
        1000 * seed / n, len(seeds), 1000 * len(hits) / n, len(learned), sum(lexicon[w] for w in learned),
        max((lexicon[w] for w in learned), default=0.0), 1000 * near / n, 1000 * sum(map(words.count, you)) / n if you else 0.0, hidden,
        capitals / size, shouted / n, count(_MARKS) / size, count(_SYMBOLS) / size, len(odd) / n, float(np.log1p(len(words))),
    ]


def _starred(word: bytes, lexicon: dict[bytes, float]) -> bool:
    shape = re.compile(b"".join(b"[a-z]" if c == 42 else re.escape(bytes([c])) for c in word.strip(b".,;:?!")))
    return any(shape.fullmatch(w) for w in (*_SEED, *lexicon))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """text and label of at most about ``max_train`` labelled rows outside the held-out fold,
    chosen by a hash of doc_id; equal texts count once. Their ids, bounded so, are broadcast."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).filter("label in (0, 1) and _id is not null")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_train / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "_id")
    return rows.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def learn(docs: DataFrame, labels: DataFrame, *, max_train: int = 8_000, min_docs: int = 5, max_words: int = 300) -> Model:
    """Fit the lexicon, the trees and the calibration on the bounded labelled sample."""
    from .store import materialize

    rows = materialize(training_rows(docs, labels, max_train), "toxic-train")

    def counted(batches):
        for b in batches:
            words, label = [], []
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                kinds = units({w.strip(_EDGE) for w in spaced_words(text.as_py())})
                words += kinds
                label += [y] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(label, pa.int32())], names=["word", "label"])

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()[0]
    n, pos = totals["n"], totals["pos"] or 0
    if n < 20 or pos < 3 or pos == n:
        return Model({})
    df = rows.mapInArrow(counted, "word binary, label int").groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (pos - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n - pos - F.col("b") + 0.5))
    sure = df.filter((F.col("a") >= min_docs) & (F.length("word") > 2)).withColumn("odds", odds)
    sure = sure.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
    top = sure.filter((F.col("odds") > 2.5) & (F.col("z") > 2.5)).orderBy(F.desc("z"), "word").limit(max_words).collect()
    model = Model({bytes(r["word"]): float(r["odds"]) for r in top})

    def described(batches):
        for b in batches:
            x = [features(t.as_py(), model.lexicon) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.float64())], names=["x", "y"])

    got = rows.mapInArrow(described, "x array<double>, y double").toPandas()  # at most max_train rows
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y = x[order], y[order]
    fold = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):  # calibration sees margins of trees that did not see the row
        margin[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    model.knots = fit_isotonic(margin, y)
    model.trees = fit_trees(x, y)
    return model


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), result: str = "score") -> DataFrame:
    """``carry`` columns and ``result`` (0 to 1) for every row of ``docs``."""
    at = carry.index("text") if "text" in carry else len(carry)
    rows = docs.select(*carry) if at < len(carry) else docs.select(*carry, F.col("text").cast("string"))
    schema = docs.select(*carry).schema.add(result, "double")

    def run(batches):
        for b in batches:
            x = [features(t.as_py(), model.lexicon) for t in b.column(at)]
            s = model.score(np.array(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(s, pa.float64())], names=[*carry, result])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, max_train: int = 8_000) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` outside the held-out fold train the model; at most about
    ``max_train`` of them, chosen by a hash. Labels, language, source and doc_id are not features.

    Null or empty text: scored on features that are all 0. Null doc_id: not held out, never
    trained on. Repeated rows: equal scores; several labels of one doc_id: the largest. No rows:
    none. Too few labels to fit (under 20 rows or 3 of a kind): 0.9 if a seed insult occurs, else
    0.1. Further columns are ignored."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, max_train=max_train))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
