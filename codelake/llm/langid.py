"""Language identification with string kernels.

A text is the set of its character n-grams of every order up to ``orders`` (presence, not
counts). The kernel of two texts is the sum over the orders of their common n-grams over the
square root of the product of their numbers of n-grams. Landmark texts give a Nyström map;
one-versus-rest ridge regression on it is the classifier. As the kernel is linear in the
presence vector, kernel, Nyström map and ridge weights fold into one matrix for each order,
and a batch is scored by one matrix product: presence rows times that matrix.

N-grams are hashed into ``2**bits`` slots for each order, so memory is fixed. Training sees a
sample of at most about ``per_lang`` texts for each language, ``max_rows`` in all; every text is
scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ASCII_FOLD = np.arange(128, dtype=np.uint32)
_ASCII_FOLD[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """True if crc32 of doc_id as text is 0 modulo 5; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def slots(text: str, orders: int, bits: int) -> list[np.ndarray]:
    """For each order the distinct slots of its n-grams; all but letters, ASCII marks
    and digits included, count as one blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 128
    points = np.where(low, _ASCII_FOLD[np.where(low, points, 0)], points)
    letter = ~low | ((points >= 97) & (points <= 122))
    points = np.where(letter, points, 32).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    out, seen = [], np.zeros(1 << bits, bool)
    for n in range(1, orders + 1):
        if len(points) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.zeros(len(points) - n + 1, np.uint64)
        for k in range(n):
            h += points[k : len(points) - n + 1 + k] * _MUL[k]
            h ^= h >> np.uint64(29)
        h *= _MUL[0]
        seen[h >> np.uint64(64 - bits)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        out.append(found)
    return out


@dataclass
class Model:
    langs: list[str]
    orders: int
    bits: int
    used: list[np.ndarray]  # by order: slots that occur in a landmark
    weights: list[np.ndarray]  # by order: used slots x languages
    bias: np.ndarray

    def decide(self, texts: list[str]) -> np.ndarray:
        """Ridge outputs, texts x languages."""
        out = np.tile(self.bias, (len(texts), 1)).astype(np.float32)
        got = [slots(t, self.orders, self.bits) for t in texts]
        for p in range(self.orders):
            presence = np.zeros((len(texts), len(self.used[p])), np.float32)
            for i, s in enumerate(got):
                if len(s[p]):
                    presence[i, np.searchsorted(self.used[p], np.intersect1d(s[p], self.used[p], assume_unique=True))] = 1 / np.sqrt(len(s[p]))
            out += presence @ self.weights[p]
        return out


def fit(texts: list[str], langs: list[str], *, orders: int = 4, bits: int = 16, **options) -> Model:
    """:func:`fit_slots` on texts."""
    return fit_slots([slots(t, orders, bits) for t in texts], langs, orders=orders, bits=bits, **options)


def fit_slots(got: list[list[np.ndarray]], langs: list[str], *, orders: int, bits: int, landmarks: int = 160, least: int = 8, ridge: float = 1e-2) -> Model:
    """Nyström map from ``landmarks`` texts, or ``least`` for each language if these are more, spread
    evenly over the languages, and ridge weights.

    ``got``: for each text the slots of each order."""
    names = sorted(set(langs))
    turn: dict[str, int] = {}
    rank = []
    for x in langs:
        turn[x] = turn.get(x, 0) + 1
        rank.append(turn[x])
    marks = sorted(range(len(got)), key=lambda i: (rank[i], i))[: max(landmarks, least * len(names))]
    used = [np.unique(np.concatenate([got[i][p] for i in marks])) for p in range(orders)]

    def matrix(rows, p):
        out = np.zeros((len(rows), len(used[p])), np.float32)
        for i, r in enumerate(rows):
            s = got[r][p]
            if len(s):
                out[i, np.searchsorted(used[p], np.intersect1d(s, used[p], assume_unique=True))] = 1 / np.sqrt(len(s))
        return out

    bases = [matrix(marks, p) for p in range(orders)]  # landmarks x slots
    kmm = sum(b.astype(np.float64) @ b.T for b in bases)
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])  # Nyström: phi(x) = k(x, landmarks) root
    phi = np.zeros((len(got), int(keep.sum())))
    for i in range(0, len(got), 256):
        rows = range(i, min(i + 256, len(got)))
        phi[i : i + 256] = sum(matrix(rows, p) @ bases[p].T for p in range(orders)) @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / langs.count(x) for x in langs]) * len(got) / len(names)
    mean = np.average(phi, 0, weight)
    centred, shift = phi - mean, np.average(target, 0, weight)
    gram = (centred * weight[:, None]).T @ centred + ridge * len(got) * np.eye(phi.shape[1]) * max(1e-9, np.trace(kmm) / len(marks)) * 0.01
    beta = np.linalg.solve(gram, (centred * weight[:, None]).T @ (target - shift))
    dual = root @ beta
    return Model(names, orders, bits, used, [(b.T @ dual).astype(np.float32) for b in bases], (shift - mean @ beta).astype(np.float32))


def learn(docs: DataFrame, *, per_lang: int = 400, max_rows: int = 40_000, orders: int = 4, bits: int = 16, **options) -> Model | None:
    """Fit on about ``per_lang`` texts a language, fewer if there are so many languages that these would
    be more than ``max_rows``; chosen by a hash of the text, equal texts count once.

    Only the n-gram slots of the sample, at most ``2**bits`` an order, reach the driver."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    per_lang = max(1, min(per_lang, max_rows // len(counts)))
    odds = F.lit(0)
    for lang, n in counts.items():
        odds = F.when(F.col("lang") == lang, int(min(1.0, 2.5 * per_lang / n) * 1_000_000)).otherwise(odds)
    mixed = F.xxhash64("text", F.lit(5))
    near = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < odds)
    near = near.groupBy("lang", mixed.alias("h")).agg(F.min("text").alias("text"))
    ordered = Window.partitionBy("lang").orderBy("h")
    sample = materialize(near.withColumn("nth", F.row_number().over(ordered)).filter(F.col("nth") <= per_lang).drop("nth"), "lang-train")

    def described(batches):
        for b in batches:
            found = [slots(t, orders, bits) if has_letter(t) else None for t in b.column(2).to_pylist()]
            packed = [[s.astype("<i4").tobytes() for s in f] if f else None for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.list_(pa.binary()))], names=["lang", "h", "s"])

    known = sample.select("lang", "h", "text").mapInArrow(described, "lang string, h long, s array<binary>").filter("s is not null")
    got, langs = [], []
    for r in known.orderBy("lang", "h").toLocalIterator():
        got.append([np.frombuffer(x, "<i4").astype(np.int64) for x in r["s"]])
        langs.append(r["lang"])
    return fit_slots(got, langs, orders=orders, bits=bits, **options) if got else None


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), block: int = 64) -> DataFrame:
    """``carry`` columns, ``lang_pred`` and ``score`` for every row."""
    rows = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    schema = docs.select(*carry).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            lang, sure = ["und"] * len(texts), np.zeros(len(texts))
            for lo in range(0, len(texts), block):
                part = texts.slice(lo, block).to_pylist()
                own = [i for i, t in enumerate(part) if has_letter(t)]
                if model is None or not own:
                    continue
                f = model.decide([part[i] for i in own]).astype(np.float64)
                e = np.exp(3 * (f - f.max(1, keepdims=True)))
                e /= e.sum(1, keepdims=True)
                for r, (i, k) in enumerate(zip(own, f.argmax(1), strict=True)):
                    lang[lo + i], sure[lo + i] = model.langs[k], e[r, k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=[*carry, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) for every row of ``docs(doc_id, text, lang)``.

    Learns from rows with a language outside the held-out fold.

    ``und`` and score 0: null text, text without a letter, or nothing to learn from. Null
    doc_id: not held out, but not sampled for training. Ties between languages: the first by
    name. Repeated rows: equal results. No rows: none. Further columns are ignored."""
    scored = predict(docs.select("doc_id", "text"), learn(docs, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
