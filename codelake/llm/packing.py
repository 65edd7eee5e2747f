"""Packing documents into fixed windows of tokens.

Every document is tokenised once. Its whole windows are sequences by themselves; what
is left (the tail, shorter than a window) is packed by a plan: shallow combinations of
tail lengths (up to three different ones, a short one also many times) that fill a window
exactly are enumerated, non-negative least squares finds how often to repeat each one so
that the histogram of tails is met, the counts are rounded down, and the remaining tails
are packed greedily, longest first, being cut at window ends. Only the histogram (one count for each length below the window) reaches the
driver. A tail finds its place from its rank among the tails of its length, which comes
from per-chunk counts, so a length that a third of all documents share needs no large group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .words import encode, vocabulary_size

BLOCKS = "doc_id long, start long, length int, doc_tokens long, chunk int, nth long, ids binary"
#: Tokens that a worker hands over at a time.
BLOCK_TOKENS = 1 << 23
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(present: np.ndarray, window: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations of up to ``depth`` (2 or 3) present lengths that sum to ``window``: rows of three
    lengths, zero-padded, and how often each one occurs.

    All multisets of ``depth`` lengths, and, for short lengths, as many copies of one as leave room
    for up to two others."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    small = present[present <= window // 2]
    pairs = small[has[window - small]]
    out = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    if depth >= 3:
        for a in present[present <= window // 3]:
            b = present[(present >= a) & (present <= (window - a) // 2)]
            b = b[has[window - a - b]]
            out.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    times = [np.ones((sum(map(len, out)), 3), np.int64)]
    for a in present[present <= window // 3]:
        for n in range(max(2, window // a - 3), window // a + 1):
            left = window - n * a
            b = present[(present <= left // 2) & (present != a)] if depth >= 3 else present[:0]
            b = b[has[left - b]]
            if left == 0 or has[left] and left != a:
                b = np.concatenate([[0], b])
            out.append(np.stack([np.full_like(b, a), b, left - b], 1))
            times.append(np.stack([np.full_like(b, n), np.ones_like(b), np.ones_like(b)], 1))
    lengths, counts = np.concatenate(out), np.concatenate(times)
    return lengths, np.where(lengths > 0, counts, 0)


def solve_nnls(combos: np.ndarray, times: np.ndarray, hist: np.ndarray, rounds: int = 14, step: int = 192) -> np.ndarray:
    """Repeat counts x >= 0 with ``A x ~ hist``, where column j of A counts the lengths of combo j.

    Active-set method: columns enter in blocks by their gradient, the passive set is solved
    by ridge-damped normal equations, and columns that turn negative leave. Misses of long
    tails weigh more, as they are the hardest to place later."""
    n, m = len(hist), len(combos)
    x = np.zeros(m)
    if not m:
        return x
    weight = np.sqrt(np.arange(n) / n + 0.05)
    valid = combos > 0
    length = np.sqrt((times**2 * weight[combos] ** 2).sum(1))
    main = np.take_along_axis(combos, np.argmax(times * (combos + 1), 1)[:, None], 1)[:, 0]
    passive = np.zeros(m, bool)
    passive[(combos[:, 0] == 0) & (times.sum(1) == 2)] = True
    for _ in range(rounds):
        for _ in range(12):
            cols = np.flatnonzero(passive)
            a = np.zeros((n, len(cols)))
            for k in range(combos.shape[1]):
                ok = valid[cols, k]
                np.add.at(a, (combos[cols, k][ok], np.flatnonzero(ok)), times[cols, k][ok].astype(float))
            a *= weight[:, None]
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-6
            s = np.linalg.solve(gram, a.T @ (weight * hist))
            if (s > 0).all() or not len(cols):
                break
            passive[cols[s <= 0]] = False
        x[:] = 0
        x[cols] = np.maximum(s, 0)
        got = np.bincount(combos[valid], weights=(x[:, None] * times)[valid], minlength=n)
        miss = weight**2 * (hist - got)
        gradient = (times * miss[combos]).sum(1)
        gradient[passive] = 0
        steep = gradient / length  # by column norm, or combinations of many copies would always lead
        order = np.argsort(-steep, kind="stable")[: 64 * step]
        order = order[gradient[order] > 1e-3 * max(1.0, hist.max())]
        best = order[np.unique(main[order], return_index=True)[1]]  # one for each length, so that a round serves many
        best = best[np.argsort(-steep[best], kind="stable")][: min(step, n - int(passive.sum()))]
        if not len(best):
            break
        passive[best] = True
    return x


@dataclass
class Plan:
    """Where the tail of a given length and rank goes; its size depends on the window alone."""

    window: int
    first: np.ndarray  # by length: its first interval
    upto: np.ndarray  # by length: one past its last interval
    low: np.ndarray  # by interval: first rank
    mult: np.ndarray  # by interval: how often the length occurs in the combination
    place: np.ndarray  # by interval: offset in the sequence of the first such tail
    base: np.ndarray  # by interval: first sequence_id of the combination
    planned: np.ndarray  # by length: tails placed by combinations
    rest_at: np.ndarray  # by length: tokens of the residual stream before its residual tails
    rest_seq: int  # sequence_id of the first residual sequence
    ends: np.ndarray  # ends of the last, shorter sequences in the residual stream
    sequences: int

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, sequence_id, offset) of its pieces."""
        if rank < self.planned[length]:
            lo, hi = self.first[length], self.upto[length]
            i = lo + int(np.searchsorted(self.low[lo:hi], rank, side="right")) - 1
            turn, slot = divmod(rank - int(self.low[i]), int(self.mult[i]))
            return [(0, length, int(self.base[i]) + turn, int(self.place[i]) + slot * length)]
        at = int(self.rest_at[length]) + (rank - int(self.planned[length])) * length
        out, done, whole = [], 0, int(self.ends[0])
        while done < length:
            if at < whole:
                seq, off = divmod(at, self.window)
                take = min(length - done, self.window - off)
                seq += self.rest_seq
            else:
                k = int(np.searchsorted(self.ends, at, side="right"))
                off = at - int(self.ends[k - 1])
                take = min(length - done, int(self.ends[k]) - at)
                seq = self.rest_seq + whole // self.window + k - 1
            out.append((done, take, seq, off))
            done, at = done + take, at + take
        return out


def make_plan(hist: np.ndarray, window: int, depth: int = 3) -> Plan:
    """``hist[n]``: number of tails of n tokens, 0 < n < window."""
    hist = hist.astype(np.int64)
    present = np.flatnonzero(hist)
    combos, times = combinations(present, window, depth) if len(present) else (np.zeros((0, 3), np.int64),) * 2
    x = solve_nnls(combos, times, hist.astype(float))
    count = np.floor(x + 1e-9).astype(np.int64)
    left = hist.copy()

    def parts(j: int) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of a combination, ascending, and how often each occurs."""
        lens, at = np.unique(combos[j][combos[j] > 0], return_inverse=True)
        return lens, np.bincount(at, weights=times[j][combos[j] > 0]).astype(np.int64)

    for j in np.flatnonzero(count):  # damping can leave a combination a little too frequent
        lens, mult = parts(j)
        count[j] = min(count[j], int((left[lens] // mult).min()))
        left[lens] -= count[j] * mult
    for j in np.argsort(-(x - np.floor(x)), kind="stable")[: 4 * window]:
        lens, mult = parts(j)
        if x[j] > 0.05 and (left[lens] >= mult).all():
            count[j] += 1
            left[lens] -= mult
    rows: dict[int, list[tuple[int, int, int, int]]] = {int(n): [] for n in present}
    planned, seq = np.zeros(window, np.int64), 0
    for j in np.flatnonzero(count):
        place = 0
        for n, mult in zip(*(v[::-1].tolist() for v in parts(j)), strict=True):
            rows[int(n)].append((int(planned[n]), mult, place, seq))
            planned[n] += mult * count[j]
            place += mult * int(n)
        seq += int(count[j])
    first, upto, flat = np.zeros(window, np.int64), np.zeros(window, np.int64), []
    for n, items in rows.items():
        first[n], upto[n] = len(flat), len(flat) + len(items)
        flat += items
    table = np.array(flat, np.int64).reshape(-1, 4)
    rest_at, at = np.zeros(window, np.int64), 0
    for n in range(window - 1, 0, -1):
        rest_at[n], at = at, at + int(left[n]) * n
    ends = [at - at % window]
    for bit in range(window.bit_length(), -1, -1):  # sequences of a power of two take no padding
        if at % window >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    total = seq + ends[0] // window + len(ends) - 1
    return Plan(window, first, upto, *table.T, planned, rest_at, seq, np.array(ends), total)


def _tokenise(path: str, window: int, eos: int, narrow: bool):
    kind = np.dtype("<u2" if narrow else "<u4")
    step = window * max(1, BLOCK_TOKENS // window)

    def run(batches):
        from pyspark import TaskContext

        chunk, ranks, whole = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        cols: list[list] = [[] for _ in range(6)]
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            ends = np.zeros(len(cols[2]) + 1, np.int64)
            np.cumsum(np.array(cols[2], np.int64) * kind.itemsize, out=ends[1:])
            data = pa.Array.from_buffers(pa.binary(), len(cols[2]), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(parts))])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), data], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(path, text.as_py()), np.uint32(eos)).astype(kind)
                n = len(ids)
                for lo in range(0, n, step):  # blocks of bounded size, whatever a text's length
                    parts.append(ids[lo : lo + step])
                    for start in range(lo, min(n, lo + step), window):
                        size = min(window, n - start)
                        if size == window:
                            nth, whole = whole, whole + 1
                        else:
                            nth = int(ranks[size])
                            ranks[size] += 1
                        for c, v in zip(cols, (doc, start, size, n, chunk, nth), strict=True):
                            c.append(v)
                    held += len(parts[-1])
                    if held >= step:
                        yield block()
                        cols, parts, held = [[] for _ in range(6)], [], 0
            if parts:
                yield block()
                cols, parts = [[] for _ in range(6)], []

    return run


def _cut(plan: Plan, narrow: bool):
    kind = np.dtype("<u2" if narrow else "<u4")
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out: dict[str, list] = {n: [] for n in names}
            for doc, start, size, total, ids, rank, chunk in zip(*(col[c] for c in ("doc_id", "start", "length", "doc_tokens", "ids", "rank", "chunk")), strict=True):
                own = np.frombuffer(ids, kind).astype("<u4")
                if size == plan.window:
                    places = [(0, size, plan.sequences + (chunk << 32 | rank), 0)]
                else:
                    places = plan.pieces(size, rank)
                for at, n, seq, off in places:
                    for c, v in zip(names, (doc, start + at, n, own[at : at + n].tobytes(), total, seq, off), strict=True):
                        out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, *, eos: int = 0, depth: int | None = None) -> DataFrame:
    """Pack every document of ``docs(doc_id, text)`` into windows; one row for each piece.

    Columns: doc_id, start and length (in the document's ids), ids (binary, little-endian
    uint32), doc_tokens, sequence_id, offset (in the sequence). A document is its token ids
    and ``eos``. All sequences are full, but for a few last ones whose lengths are powers of
    two, so nothing is padded. ``depth``: lengths in a combination (3; 2 for windows over 2048).

    Null or empty text: the one id ``eos``. Null doc_id: packed like others. Repeated rows:
    each is packed by itself. No rows: no pieces. Further columns are ignored."""
    narrow = max(vocabulary_size(tokenizer), eos + 1) <= 1 << 16
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialize(tokens.mapInArrow(_tokenise(tokenizer, window, eos, narrow), BLOCKS), "blocks")
    whole = blocks.filter(F.col("length") == window).withColumn("rank", F.col("nth"))
    tails = blocks.filter(F.col("length") < window)
    counts = tails.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "tail-counts")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length below the window
        hist[r["length"]] = r["n"]
    plan = make_plan(hist, window, depth or (3 if window <= 2048 else 2))
    ranked = tails.join(counts.drop("n"), ["length", "chunk"]).withColumn("rank", F.col("nth") + F.col("before"))
    cols = ["doc_id", "start", "length", "doc_tokens", "ids", "rank", "chunk"]
    return whole.select(cols).unionByName(ranked.select(cols)).mapInArrow(_cut(plan, narrow), PIECES)
