"""Benchmark leaks in documents: latent semantic retrieval, then alignment.

1. Documents become word numbers of the benchmark's vocabulary; other words are blanks.
2. Passages are 32 words, dealt every 16 words. Document frequencies over all documents weigh
   the words, and a randomised SVD of all passages' TF-IDF rows gives the latent space: each
   partition adds up its share of ``A'(A Omega)``, the shares are summed by Spark, and the driver
   solves the small rest (Nystroem form, one pass).
3. Passages of documents and of items that are near by cosine in that space are candidates; the
   items' passages are in an inverted file, of which a document's passage meets the nearest lists.
   An exact filter completes them: places that hold as many of an item's rarest words as a copy
   must hold, or the rarest ones of its answer or of a stretch of it, so that no copy is missed
   whichever words were replaced and whatever lists were met.
4. A candidate is confirmed by the longest common subsequence of the item and the words around
   the passage, or a shorter one if the item's answer, its last words, stands there word by word.
5. A latent candidate that shares too few words for that is a paraphrase if the answer stands
   there and the words before it are near the item's question in the latent space.

There is one vocabulary and one space for all items, and texts are read and encoded once. Items are
sent to the tasks in blocks of bounded size; each meets the encoded texts by itself, so what
is found does not depend on the size of the blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .words import alnum_words

HALF = 16
IN_CACHE = 512  # rows of a table that are added at a time
#: Terms of the latent space: words share one where the benchmark has more.
SLOTS = 1 << 16
MATCHES = "doc_id long, item_id long, first_word long, n_words long, cosine double, lcs_share double, answer boolean, exact boolean"


@dataclass(frozen=True)
class Rule:
    """What confirms a candidate (see :func:`contaminated`)."""

    share: float
    share_with_answer: float
    answer_words: int
    min_words: int
    run_words: int
    paraphrase: float = 0.75


@dataclass
class Items:
    """A block of the benchmark: word numbers of each item, and the size of the vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    size: int

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (rows of 32, padded with the blank) and the item of each passage."""
        rows, item = [], []
        for i, w in enumerate(self.words):
            for at in range(0, max(1, len(w) - HALF), HALF):
                own = w[at : at + 2 * HALF]
                rows.append(np.pad(own, (0, 2 * HALF - len(own)), constant_values=self.size))
                item.append(i)
        return np.array(rows, np.int64).reshape(-1, 2 * HALF), np.array(item, np.int64)


def read_items(rows, vocab: dict[bytes, int], least_words: int, block_words: int):
    """Blocks of items of about ``block_words`` words at most; ``vocab`` grows."""
    ids, words, held = [], [], 0
    for item, text in rows:
        own = alnum_words(text)
        if len(own) >= least_words:
            ids.append(item)
            words.append(np.array([vocab.setdefault(w, len(vocab)) for w in own], np.int32))
            held += len(own)
            if held >= block_words:
                yield Items(ids, words, len(vocab))
                ids, words, held = [], [], 0
    if ids:
        yield Items(ids, words, len(vocab))


def _encode(vocab: dict[bytes, int]):
    narrow = np.dtype("<u2" if len(vocab) < 65_535 else "<u4")

    def run(batches):
        blank, get = len(vocab), vocab.get
        for b in batches:
            out = []
            for t in b.column(1):
                words = alnum_words(t.as_py())
                out.append(np.fromiter([get(w, blank) for w in words], narrow, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "words"])

    return run, narrow


def _frequencies(size: int, narrow: np.dtype):
    def run(batches):
        seen, docs = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for w in b.column(0):
                seen[np.unique(np.frombuffer(w.as_py(), narrow))] += 1
                docs += 1
        seen[size] = docs
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    return run


def _blocks(words: list[np.ndarray], blank: int):
    """All documents' words in rows of HALF, and for each row whether its successor is of the same document."""
    rows, joins = [], []
    for w in words:
        n = -(-len(w) // HALF)
        padded = np.full(n * HALF, blank, np.int64)
        padded[: len(w)] = w
        rows.append(padded.reshape(n, HALF))
        joins.append(np.arange(n) < n - 1)
    return (np.concatenate(rows), np.concatenate(joins)) if rows else (np.zeros((0, HALF), np.int64), np.zeros(0, bool))


def _sums(values: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``values[at]`` over the stretches that begin at ``start``, some at a time."""
    out = np.empty((len(start), values.shape[1]), values.dtype)
    stop = np.append(start[1:], len(at))
    cuts = np.append(np.flatnonzero(np.diff(start // IN_CACHE, prepend=-1)), len(start))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = start[a], stop[b - 1]
        np.add.reduceat(values.take(at[lo:hi], axis=0, mode="clip"), start[a:b] - lo, axis=0, out=out[a:b])
    return out


def _pass(rows: np.ndarray, joins: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each passage: a row and its successor."""
    half = np.empty((len(rows), table.shape[1]), np.float32)
    near = np.empty((IN_CACHE, table.shape[1]), np.float32)
    for lo in range(0, len(rows), IN_CACHE):
        own, some = half[lo : lo + IN_CACHE], rows[lo : lo + IN_CACHE].T
        np.take(table, some[0], axis=0, out=own, mode="clip")
        for at in some[1:]:
            own += np.take(table, at, axis=0, out=near[: len(own)], mode="clip")
    both = half.copy()
    both[:-1][joins[:-1]] += half[1:][joins[:-1]]
    return both


def _chunks(column, narrow: np.dtype, most: int = 150_000):
    """Lists of (position in the batch, words) of about ``most`` words."""
    held, size = [], 0
    for i, w in enumerate(column):
        held.append((i, np.frombuffer(w.as_py(), narrow)))
        size += len(held[-1][1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def slot_numbers(size: int) -> np.ndarray:
    """The term of each word, and of the blank, which comes last."""
    terms = min(size, SLOTS)
    return np.append(np.arange(size) % max(1, terms), terms).astype(np.int64)


def _sketch(omega: np.ndarray, idf: np.ndarray, narrow: np.dtype, slot: np.ndarray):
    """Shares of A'(A Omega), a row for each term."""

    def run(batches):
        blank = len(idf)
        table = np.vstack([omega * idf[:, None], np.zeros(omega.shape[1])]).astype(np.float32)
        total, used = np.zeros((blank, omega.shape[1])), np.zeros(blank, bool)
        for b in batches:
            for part in _chunks(b.column(0), narrow):
                rows, joins = _blocks([slot[w] for _, w in part], blank)
                both = _pass(rows, joins, table)
                grad = both.copy()
                grad[1:][joins[:-1]] += both[:-1][joins[:-1]]
                flat = rows.ravel()
                at = np.flatnonzero(flat < blank)
                order = np.argsort(flat[at].astype(np.min_scalar_type(blank)), kind="stable")  # 16 bits are sorted by radix
                at = at[order]
                if len(at):
                    start = np.flatnonzero(np.diff(flat[at], prepend=-1))
                    terms = flat[at[start]]
                    total[terms] += _sums(grad, at // HALF, start) * idf[terms, None]
                    used[terms] = True
        terms = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(total[terms].tolist(), pa.list_(pa.float64()))], names=["term", "y"])

    return run


def latent_space(encoded: DataFrame, idf: np.ndarray, narrow: np.dtype, slot: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Terms x rank: idf times the leading right singular vectors of the passages' TF-IDF matrix,
    over their singular values, so that the directions of the most common words don't rule the cosine."""
    size = len(idf)
    width = min(size, rank + 8)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    shares = encoded.select("words").mapInArrow(_sketch(omega.astype(np.float32), idf, narrow, slot), "term long, y array<double>")
    summed = shares.groupBy("term").agg(F.array(*[F.sum(F.col("y")[k]) for k in range(width)]).alias("y"))
    y = np.zeros((size, width))
    found = summed.toArrow()  # a row for each term, SLOTS at most, in one job
    if found.num_rows:
        y[found.column("term").to_numpy()] = found.column("y").combine_chunks().flatten().to_numpy().reshape(-1, width)
    shift = 1e-7 * max(np.linalg.norm(y), 1e-12)
    y += shift * omega
    core = omega.T @ y
    low = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / width * np.eye(width))
    vectors, values, _ = np.linalg.svd(np.linalg.solve(low, y.T).T, full_matrices=False)
    kept = values[:rank] > 1e-6 * max(values[0], 1e-12)
    return (vectors[:, :rank][:, kept] / values[:rank][kept] * values[0] * idf[:, None]).astype(np.float32)


def common_subsequence(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(length, first, end): words of ``item`` found in order in ``region``, and where they lie.

    Bit-parallel lengths; the place is that of words that match in the shortest stretch found
    by trimming both ends while the length holds."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1

    def length(words) -> list[int]:
        v, out = full, []
        for w in words:
            u = v & masks.get(w, 0)
            v = ((v + u) | (v - u)) & full
            out.append(len(item) - v.bit_count())
        return out

    words = region.tolist()
    upto = length(words)
    best = upto[-1] if upto else 0
    if not best:
        return 0, 0, 0
    end = upto.index(best) + 1
    masks_back: dict[int, int] = {}
    for i, w in enumerate(item.tolist()[::-1]):
        masks_back[w] = masks_back.get(w, 0) | 1 << i
    masks = masks_back
    back = length(words[:end][::-1])
    return best, end - (back.index(best) + 1), end


def _starts(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Places of ``region`` where ``item`` stands word by word."""
    at = np.flatnonzero(region[: max(0, len(region) - len(item) + 1)] == item[0])
    for k, w in enumerate(item):
        if not len(at):
            break
        at = at[region[at + k] == w]
    return at


def longest_run(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(length, first): the longest stretch of ``region`` that stands in ``item`` word by word."""
    best, first = 0, 0
    now = np.zeros(len(item) + 1, np.int64)
    for at, w in enumerate(region):
        now[1:] = np.where(item == w, now[:-1] + 1, 0)
        top = int(now.max())
        if top > best:
            best, first = top, at + 1 - top
    return best, first


def verify(item: np.ndarray, words: np.ndarray, lo: int, hi: int, rule: Rule):
    """(share, answer, exact, first word, words) of the item's best place in ``words[lo:hi]``, None if
    none is confirmed by ``rule``."""
    lo = max(0, lo)
    region = words[lo:hi].astype(np.int64)
    if len(item) < rule.min_words:  # only as a whole
        at = _starts(item, region)
        return (1.0, True, True, lo + int(at[0]), len(item)) if len(at) else None
    found = _subsequence(item, words, lo, hi, rule)
    if found is None and len(item) > rule.run_words:
        n, first = longest_run(item, region)
        if n >= rule.run_words:
            return n / len(item), False, False, lo + first, n
    return found


def _subsequence(item: np.ndarray, words: np.ndarray, lo: int, hi: int, rule: Rule):
    """The best place of at most twice the item's words."""
    share, share_with_answer, answer_words, span = rule.share, rule.share_with_answer, rule.answer_words, 2 * len(item)
    region = words[lo:hi].astype(np.int64)
    if not len(region):
        return None
    known = np.sort(region)  # words of the item that the region lacks altogether bound its share
    if (known[np.minimum(np.searchsorted(known, item), len(known) - 1)] == item).sum() < share_with_answer * len(item):
        return None
    top, first, end = common_subsequence(item, region)
    if top < share_with_answer * len(item):
        return None
    tail = item[-answer_words:]
    runs = _starts(tail, region)

    def answered(first: int, end: int) -> bool:
        return bool(((runs >= first) & (runs + len(tail) <= end + answer_words)).any())

    answer = answered(first, end)
    if end - first <= span and (top >= share * len(item) or answer):
        best = top, first, end, answer
    else:
        # the longest one takes stray words from afar, or lacks the answer: the best one of each stretch
        best = None
        inside = np.isin(region, item)
        upto = np.concatenate([[0], np.cumsum(inside)])
        starts = np.flatnonzero(inside)
        held = upto[np.minimum(starts + span, len(region))] - upto[starts]
        near = np.zeros(len(starts), bool)  # stretches that may have the answer
        for at in runs:
            near |= (starts <= at) & (starts + span + answer_words >= at + len(tail))
        least = np.where(near, share_with_answer, share) * len(item)
        if top < share * len(item):
            least[~near] = np.inf
        for at, n, need in zip(starts.tolist(), held.tolist(), least.tolist(), strict=True):
            if n < need or best and n <= best[0]:
                continue
            got, first, end = common_subsequence(item, region[at : at + span])
            first, end = at + first, at + end
            if got >= need and (best is None or got > best[0]):
                answer = answered(first, end)
                if got >= share * len(item) or answer:
                    best = got, first, end, answer
                    if got == top:
                        break
        if best is None:
            return None
    got, first, end, answer = best
    return got / len(item), answer, bool(len(_starts(item, region[first:end]))), lo + first, end - first


class RareWords:
    """Finds every place where a copy of an item can be, by a few of its rarest words.

    A copy holds ``least`` of the n words of an item, so it lacks n - ``least`` of them at most, and
    has ``FEW`` of any n - ``least`` + ``FEW`` words: the rarest are looked up. A copy with the answer
    has all words of that, so any ``FEW`` of these; so has a short item, and a run of a long one."""

    FEW = 5

    def __init__(self, words: list[np.ndarray], df: np.ndarray, rule: Rule):
        need, within, reach, item, word, number = [], [], [], [], [], []
        for i, w in enumerate(words):
            tail = w[-rule.answer_words :]
            least = max(1, int(np.ceil(rule.share * len(w) - 1e-9)))
            own_rules = [(w, least, 2 * len(w)), (tail, len(tail), len(tail))] if len(w) >= rule.min_words else [(w, len(w), len(w))]
            if len(w) > rule.run_words:  # a run holds one of these parts as a whole
                half = rule.run_words // 2
                own_rules += [(w[at : at + half], half, half) for at in range(0, len(w) - half + 1, half)]
            for own, all_, span in own_rules:
                few = min(self.FEW, all_)
                rare = own[np.argsort(df[own], kind="stable")[: len(own) - all_ + few]]
                word.append(rare)
                number.append(np.full(len(rare), len(need)))
                need.append(few)
                within.append(span)
                reach.append(2 * len(w) + rule.answer_words)
                item.append(i)
        flat, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, number))
        self.rule = number[np.argsort(flat, kind="stable")]
        self.count = np.bincount(flat, minlength=len(df) + 1)  # the blank is in no item
        self.first = np.cumsum(self.count) - self.count
        self.need, self.within, self.reach, self.item = np.array(need), np.array(within), np.array(reach), np.array(item)

    def places(self, part):
        """(place in the list, item, from, to) in ``part``, a list of (_, words): all copies lie in one of them."""
        ends = np.cumsum([len(w) for _, w in part])
        flat = np.concatenate([w for _, w in part]).astype(np.int64)
        at = np.flatnonzero(self.count[flat])
        n = self.count[flat[at]]
        pos = np.repeat(at, n)
        rule = self.rule[np.repeat(self.first[flat[at]] - (np.cumsum(n) - n), n) + np.arange(len(pos))]
        doc = np.searchsorted(ends, pos, side="right")
        order = np.lexsort((pos, rule, doc))
        pos, rule, doc = pos[order], rule[order], doc[order]
        last = np.arange(len(pos)) + self.need[rule] - 1
        safe = np.minimum(last, len(pos) - 1)
        full = (last == safe) & (doc[safe] == doc) & (rule[safe] == rule) & (pos[safe] - pos < self.within[rule])
        pos, upto, rule, doc = pos[full], pos[safe[full]], rule[full], doc[full]
        start = (ends - [len(w) for _, w in part])[doc]
        lo, hi = np.maximum(upto - self.reach[rule] - start, 0), pos + self.reach[rule] + 1 - start
        if len(pos):
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rule[1:] != rule[:-1]) | (lo[1:] > hi[:-1])]))
            upto = np.concatenate([new[1:], [len(pos)]]) - 1
            yield from zip(doc[new].tolist(), self.item[rule[new]].tolist(), lo[new].tolist(), hi[upto].tolist(), strict=True)


def paraphrased(item: np.ndarray, words: np.ndarray, lo: int, hi: int, table: np.ndarray, slot: np.ndarray, rule: Rule):
    """(share, answer, exact, first word, words) of the item's answer in ``words[lo:hi]`` after words
    that are nearest to the item's question in the latent space ``table``, None if none are near.

    The words before the answer are taken at three quarters, once and one and a quarter times the
    question's length. A question has at least as many words as an item that is confirmed by them."""
    tail, question = item[-rule.answer_words :], item[: -rule.answer_words]
    if len(question) < rule.min_words:
        return None
    lo, near, place = max(0, lo), rule.paraphrase, None
    answers = (lo + _starts(tail, words[lo:hi])).tolist()
    if not answers:
        return None
    target = table[slot[question]].sum(0)
    target /= max(float(np.linalg.norm(target)), 1e-12)
    for at in answers:
        for n in (len(question), len(question) * 3 // 4, len(question) * 5 // 4):
            if 0 < n <= at:
                own = table[slot[words[at - n : at]]].sum(0)
                cosine = float(own @ target) / max(float(np.linalg.norm(own)), 1e-12)
                if cosine >= near and (place is None or cosine > near):
                    near, place = cosine, (at - n, n + len(tail))
    if place is None:
        return None
    first, n = place
    return common_subsequence(item, words[first : first + n].astype(np.int64))[0] / len(item), True, False, first, n


def _pieces(places: list[tuple[int, int]], n: int):
    """The places joined where they overlap, and cut into pieces of ``4 * n`` words at most, so that
    each stretch of ``2 * n`` words, and the answer behind it, is within one."""
    joined: list[list[int]] = []
    for lo, hi in sorted(places):
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    for lo, hi in joined:
        while hi - lo > 4 * n:
            yield lo, lo + 4 * n
            lo += 2 * n
        yield lo, hi


class Lists:
    """An inverted file over unit vectors: each is in the list of its nearest centre.

    Centres, as many as the root of the vectors, are fitted on 32,768 of them at most; all are listed."""

    def __init__(self, vectors: np.ndarray, probes: int = 16, sample: int = 1 << 15):
        self.vectors, n = vectors, len(vectors)
        count = max(1, int(np.ceil(np.sqrt(n))))
        some = vectors[np.linspace(0, n - 1, min(n, sample)).astype(np.int64)]
        self.centres = some[np.linspace(0, len(some) - 1, count).astype(np.int64)].copy()
        for _ in range(6):
            own = (some @ self.centres.T).argmax(1)
            total = np.zeros_like(self.centres)
            np.add.at(total, own, some)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            self.centres = np.where(size > 0, total / np.maximum(size, 1e-12), self.centres)
        own = np.concatenate([(vectors[lo : lo + 8192] @ self.centres.T).argmax(1) for lo in range(0, n, 8192)])
        self.order = np.argsort(own, kind="stable")
        self.first = np.searchsorted(own[self.order], np.arange(count + 1))
        self.probes = min(probes, count)

    def near(self, rows: np.ndarray, least: np.ndarray):
        """(row, vector) for products of ``least`` (by vector) or more, in the nearest lists of each row."""
        to = np.argpartition(-(rows @ self.centres.T), self.probes - 1, axis=1)[:, : self.probes]
        row, at = np.repeat(np.arange(len(rows)), self.probes), to.ravel()
        order = np.argsort(at, kind="stable")
        row, ends = row[order], np.searchsorted(at[order], np.arange(len(self.centres) + 1))
        for k in range(len(self.centres)):
            own, listed = row[ends[k] : ends[k + 1]], self.order[self.first[k] : self.first[k + 1]]
            if len(own) and len(listed):
                r, c = np.nonzero(rows[own] @ self.vectors[listed].T >= least[listed])
                yield from zip(own[r].tolist(), listed[c].tolist(), strict=True)


def _search(items: Items, space: np.ndarray, df: np.ndarray, narrow: np.dtype, slot: np.ndarray, cosine: float, rule: Rule, rare_words: bool):
    def run(batches):
        blank = len(space)
        table = np.vstack([space, np.zeros((1, space.shape[1]), np.float32)])
        rows, owner = items.passages()
        target = table[slot[rows]].sum(1)
        target /= np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-12)
        lists = Lists(target)
        passages = np.searchsorted(owner, np.arange(len(items.ids) + 1))
        # a short passage fills only a part of the document's passage around it
        least = (cosine * np.sqrt((rows < items.size).sum(1) / (2 * HALF))).astype(np.float32)
        rare = RareWords(items.words, df, rule) if rare_words else None
        names = [c.split()[0] for c in MATCHES.split(", ")]
        for b in batches:
            out: list[tuple] = []
            docs = b.column(0).to_pylist()
            for part in _chunks(b.column(1), narrow):
                blocks, joins = _blocks([slot[w] for _, w in part], blank)
                both = _pass(blocks, joins, table)
                size = np.linalg.norm(both, axis=1, keepdims=True)
                both /= np.maximum(size, 1e-12)
                some = np.flatnonzero(size[:, 0] > 0)
                ends = np.cumsum([-(-len(w) // HALF) for _, w in part])
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for lo in range(0, len(some), 8192):
                    own = some[lo : lo + 8192]
                    for row, col in lists.near(both[own], least):
                        row = int(own[row])
                        k = int(np.searchsorted(ends, row, side="right"))
                        start = (row - int(ends[k - 1] if k else 0)) * HALF
                        reach = len(items.words[owner[col]]) + HALF
                        hits.setdefault((k, int(owner[col])), []).append((max(0, start - reach), start + 2 * HALF + reach))
                latent = {key: list(places) for key, places in hits.items()}
                for k, i, lo, hi in rare.places(part) if rare else ():
                    hits.setdefault((k, i), []).append((lo, hi))
                for (k, i), places in sorted(hits.items()):
                    pos, words = part[k]
                    best = None
                    for lo, hi in _pieces(places, len(items.words[i]) + rule.answer_words):
                        found = verify(items.words[i], words, lo, hi, rule)
                        if found and (best is None or found[0] > best[0]):
                            best = found
                            if found[0] == 1:
                                break
                    if best is None:
                        for lo, hi in _pieces(latent.get((k, i), []), len(items.words[i]) + rule.answer_words):
                            best = best or paraphrased(items.words[i], words, lo, hi, table, slot, rule)
                    if best:
                        base = int(ends[k - 1]) if k else 0
                        around = both[base + max(0, best[3] // HALF - 1) : base + (best[3] + best[4] - 1) // HALF + 1]
                        near = float((around @ target[passages[i] : passages[i + 1]].T).max())
                        out.append((docs[pos], items.ids[i], best[3], best[4], near, best[0], best[1], best[2]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)], names=names)

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, cosine: float = 0.55, share: float = 0.7, share_with_answer: float = 0.5, answer_words: int = 8,
    min_words: int = 8, least_words: int = 4, run_words: int = 64, paraphrase: float = 0.75, rare_words: bool = True, rank: int = 96, block_words: int = 4_000_000,
) -> DataFrame:
    """One row for each document of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)``
    that leaks into it, at its best place.

    Columns: doc_id, item_id, first_word and n_words (the place, in words), cosine, lcs_share
    (share of the item's words found in order), answer, exact (the whole item word by word).
    Candidates have a ``cosine`` of that much, less for passages under 32 words; with ``rare_words``
    also enough of an item's rarest words (:class:`RareWords`), so that no copy is missed.
    Confirmed are ``share`` of the words, or ``share_with_answer`` and the last ``answer_words``
    words in one piece, within a stretch of at most twice the item's words; or ``run_words`` words
    of a longer item in one piece; or the last ``answer_words`` words of an item with a question of
    ``min_words`` or more, after words whose cosine to the question is ``paraphrase`` or more. Items under ``min_words`` words are confirmed as a whole, word by word.

    Items that are null or have under ``least_words`` words cannot be told from chance and match
    nothing. Null or empty text, empty tables: no rows. Null doc_id: matched, doc_id null. Ties
    between places: the first. Repeated documents: a row each; repeated items: one. Further
    columns are ignored. Tasks hold the benchmark's vocabulary and ``block_words`` words of items
    at a time; the driver holds no more."""
    rule = Rule(share, share_with_answer, answer_words, min_words, run_words, paraphrase)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    items = materialize(items.groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id"), "items")

    def blocks(vocab):
        rows = ((r["item_id"], r["text"]) for r in items.toLocalIterator())  # a file or several at a time
        return read_items(rows, vocab, least_words, block_words)

    out, vocab = docs.sparkSession.createDataFrame([], MATCHES), {}
    n_blocks = sum(1 for _ in blocks(vocab))
    if not n_blocks:
        return out
    size, slot = len(vocab), slot_numbers(len(vocab))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, narrow = _encode(vocab)
    encoded = materialize(texts.mapInArrow(run, "doc_id long, words binary"), "words")
    counts = encoded.select("words").mapInArrow(_frequencies(size, narrow), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = counts.toArrow()  # a row for each word of the benchmark, in one job
    df = np.zeros(size + 1)
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    df, n_docs = df[:-1], int(df[-1])
    by_term = np.bincount(slot[:-1], weights=df, minlength=slot[-1])
    # the third power: what tells passages apart is rare words, not how often common ones stand in them
    idf = np.maximum(np.log((n_docs + 1) / (np.minimum(by_term, n_docs) + 0.5)), 0.05) ** 3
    space = latent_space(encoded, idf, narrow, slot, min(rank, len(idf)))
    for block in blocks(vocab):
        found = encoded.mapInArrow(_search(block, space, df, narrow, slot, cosine, rule, rare_words), MATCHES)
        out = out.unionByName(found if n_blocks == 1 else materialize(found, "leaks"))
    return out
