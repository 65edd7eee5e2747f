import random

import numpy as np

from codelake.llm import decontam
from codelake.llm.queries import op5_decontamination
from codelake.llm.words import alnum_words


RULE = decontam.Rule(0.7, 0.5, 8, 8, 64)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def planted(vocabulary):
    rng = random.Random(2)
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(14, 70))) for i in range(60)]
    docs, want = [], set()
    for d in range(400):
        body = text(rng.randint(30, 400))
        if d % 5 == 0:
            i, w = items[d // 5 % 60]
            w = list(w)
            if d % 2:  # an edited copy
                for _ in range(len(w) // 8):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            at = rng.randrange(len(body))
            body[at:at] = w
            want.add((d, i))
        docs.append((d, " ".join(body)))
    return docs, [(i, " ".join(w)) for i, w in items], want


def test_planted_items(spark, vocabulary):
    docs, items, want = planted(vocabulary)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    by = dict(docs)
    for r in got:
        words = alnum_words(by[r["doc_id"]])
        item = alnum_words(dict(items)[r["item_id"]])
        found = lcs(item, words[r["first_word"] : r["first_word"] + r["n_words"]])
        assert abs(found / len(item) - r["lcs_share"]) < 1e-9
    blocks = decontam.contaminated(frame, bench, block_words=400).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))


def test_hot_item(spark, vocabulary):
    """An item that half of the documents hold."""
    rng = random.Random(4)
    item = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(60)) + (f" {item} end" if d % 2 else "")) for d in range(200)]
    others = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(10)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(99, item), *others], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, 99) for d in range(1, 200, 2)}


def test_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(1, 30)), rng.integers(0, 12, rng.integers(0, 60))
        n, first, end = decontam.common_subsequence(a, b)
        assert n == lcs(a.tolist(), b.tolist())
        assert lcs(a.tolist(), b[first:end].tolist()) == n


def brute_share(item, words):
    """The largest share of the item's words found in order within twice its words."""
    span = 2 * len(item)
    return max(lcs(item, words[s : s + span]) for s in range(max(1, len(words) - span + 1))) / len(item)


def test_rarest_words_replaced(spark, vocabulary):
    """Copies without their rarest words are found: brute force over all places."""
    rng = random.Random(11)
    common = lambda n: rng.choices(vocabulary[:60], weights=range(60, 0, -1), k=n)
    items, docs = [], []
    for i in range(40):
        n = rng.randint(16, 50)
        words = common(n)
        for k in rng.sample(range(n), n // 3):
            words[k] = f"rare{i}x{k}"
        items.append((i, words))
        rare = [k for k, w in enumerate(words) if w.startswith("rare")]
        for part in (0.1, 0.2, 0.28):
            copy = list(words)
            for k in rare[: int(part * n)]:
                copy[k] = f"unknown{k}"
            docs.append((len(docs), common(rng.randint(20, 120)) + copy + common(rng.randint(20, 120))))
        copy = [f"unknown{k}" if k in rare else w for k, w in enumerate(words)]  # 2/3 of the words, with the answer
        copy[-8:] = words[-8:]
        docs.append((len(docs), common(60) + copy + common(60)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(4), bench).collect()}
    want = {(4 * i + k, i) for i in range(40) for k in range(4)}
    assert want <= got
    for d, i in got - want:
        assert brute_share(items[i][1], docs[d][1]) >= 0.5
    for d, w in docs[::3]:
        for i, item in items[::3]:
            assert (d, i) in got or brute_share(item, w) < 0.7


def test_stray_words():
    """An edge word that was replaced and recurs nearby does not hide the copy."""
    rng = random.Random(6)
    item = np.arange(10)
    words = np.full(80, 99)
    words[41:50] = item[1:]
    words[26] = item[0]  # 15 words before the second one
    assert decontam.verify(item, words, 14, 74, RULE) == (0.9, True, False, 41, 9)
    for _ in range(150):
        n = rng.randint(10, 40)
        item, words = np.arange(n), np.full(8 * n + 32, 999)
        at, gone = 2 * n + rng.randint(0, n), rng.sample(range(n), rng.randint(1, n // 4))
        words[at : at + n] = item
        words[at + np.array(gone)] = 998
        for w in gone:  # strays before and after the copy
            words[at - rng.randint(n // 2, n + 16) if rng.random() < 0.5 else at + n + rng.randint(n // 2, n + 15)] = w
        lo, hi = max(0, at - n - 16), at + 2 * n + 16
        top = max(lcs(item.tolist(), words[s : s + 2 * n].tolist()) for s in range(lo, hi - 2 * n + 1))
        got = decontam.verify(item, words, lo, hi, RULE)
        assert got and abs(got[0] - top / n) < 1e-9 and got[4] <= 2 * n
        assert lcs(item.tolist(), words[got[3] : got[3] + got[4]].tolist()) == top


def test_short_items_and_long_runs(spark, vocabulary):
    """Short items are found as a whole, and a long stretch of a long item without its end."""
    rng = random.Random(12)
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    short, long = text(5), text(300)
    docs = [
        text(40) + short + text(40), text(40) + short[:2] + ["other"] + short[3:] + text(40), short, text(50) + short[:4] + text(50),
        text(40) + long[100:200] + text(40), text(40) + long[:130] + text(30), text(40) + long[30:80] + text(40), text(20) + long + text(20),
    ]
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long)), (3, "two words")], "item_id long, text string")
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(frame, bench).collect()}
    assert set(got) == {(0, 1), (2, 1), (4, 2), (5, 2), (7, 2)}
    assert got[0, 1]["exact"] and (got[0, 1]["first_word"], got[0, 1]["n_words"]) == (40, 5)
    assert got[4, 2]["first_word"] == 40 and got[4, 2]["n_words"] == 100 and abs(got[4, 2]["lcs_share"] - 1 / 3) < 1e-9
    assert got[7, 2]["exact"]


def test_lists_find_near_passages():
    """Share of the products over the threshold that the nearest lists hold, against all products."""
    rng = np.random.default_rng(5)
    found = all_ = 0
    for n in (1, 7, 400, 3000):
        vectors = rng.standard_normal((n, 24)).astype(np.float32)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        rows = vectors[rng.integers(0, n, 500)] + 0.15 * rng.standard_normal((500, 24)).astype(np.float32)
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        least = np.full(n, 0.55, np.float32)
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(rows @ vectors.T >= least)), strict=True))
        got = list(decontam.Lists(vectors).near(rows, least))
        assert len(got) == len(set(got)) and set(got) <= want
        found, all_ = found + len(got), all_ + len(want)
    assert found >= 0.9 * all_


def test_words_may_share_terms(spark, vocabulary, monkeypatch):
    """What is found does not depend on the terms of the space."""
    docs, items, want = planted(vocabulary)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "SLOTS", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench).collect()} == want


def test_odd_rows(spark, odd, none, clashing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "x " * 20), (4, "a text without an id that is long enough to count"), (4, "a text without an id that is long enough to count"), (5, "long " * 30)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(clashing(odd), clashing(bench)).collect()]
    assert got.count((None, 4)) == 2 and {i for _, i in got} == {4, 5}
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontamination(spark, sf).collect()}
    items = [(r["item_id"], b" ".join(alnum_words(r["text"]))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], b" " + b" ".join(alnum_words(r["text"])) + b" ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    exact = {(d, i) for d, t in docs for i, w in items if w and b" " + w + b" " in t}
    assert exact and exact <= got and len(got - exact) <= 3


def bit_lcs(item, words):
    """Length of the longest common subsequence, a word at a time over bits of the item."""
    at = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    row, full = (1 << len(item)) - 1, (1 << len(item)) - 1
    for w in words:
        both = row & at.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def test_latent_search_alone_against_all_pairs(spark):
    """Without the exact filter, nine of ten pairs of plain LCS over all documents and items are found;
    the filter finds the rest; without the latent space nothing is a candidate."""
    rng = random.Random(21)
    sf = "/root/testdata/sf0.01"
    items = [(r["item_id"], [w.decode() for w in alnum_words(r["text"])]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [[w.decode(errors="replace") for w in alnum_words(r["text"])] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    corpus = [w for d in docs for w in d]
    for d in range(0, len(docs), 3):  # copies with words replaced, dropped or put in
        copy = list(items[d // 3 % len(items)][1])
        for _ in range(int((d // 3 % 4) * 0.09 * len(copy))):
            at, kind = rng.randrange(len(copy)), rng.randrange(3)
            copy[at : at + 1] = [[rng.choice(corpus)], [], [copy[at], rng.choice(corpus)]][kind]
        at = rng.randrange(len(docs[d]) + 1)
        docs[d] = docs[d][:at] + copy + docs[d][at:]
    want = {(d, i) for d, w in enumerate(docs) for i, item in items if bit_lcs(item, w) >= 0.7 * len(item) and any(bit_lcs(item, w[s : s + 2 * len(item)]) >= 0.7 * len(item) for s in range(max(1, len(w) - 2 * len(item) + 1)))}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = lambda **rule: {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench, **rule).collect()}
    latent = found(rare_words=False)
    assert len(want) > len(docs) // 4 and len(latent & want) >= 0.9 * len(want)
    assert want <= found()
    assert not found(rare_words=False, cosine=9.0)


def test_paraphrases(spark):
    """A question in other words before the same answer: only the latent space knows that words go together."""
    rng = random.Random(8)
    topics = [[[f"t{t}c{c}s{s}" for s in range(4)] for c in range(10)] for t in range(40)]

    def passage(t, n):
        return [rng.choice(rng.choice(topics[t])) for _ in range(n)]

    items = []
    for i in range(400):
        items.append((i, i % 40, passage(i % 40, 28) + [f"a{i}x{k}" for k in range(8)]))
    docs = [sum((passage(rng.randrange(40), 60) for _ in range(4)), []) for _ in range(600)]
    want = set()
    for d in range(0, 600, 3):
        i, t, words = items[d % 400]
        said = [rng.choice([w for w in c if w != own] or c) for own in words[:-8] for c in topics[t] if own in c]
        near = d % 2 == 0  # else the answer stands after words of another topic
        body = (said if near else passage((t + 7) % 40, 28)) + words[-8:]
        at = 60 * rng.randrange(5)
        docs[d] = docs[d][:at] + body + docs[d][at:]
        if near:
            want.add((d, i))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, _, w in items], "item_id long, text string")
    got = decontam.contaminated(frame, bench, rare_words=False).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(pairs & want) >= 0.9 * len(want) and not pairs - want
    assert all(r["answer"] and not r["exact"] and r["lcs_share"] < 0.5 for r in got)
    assert not {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench, cosine=9.0).collect()} & want


def test_sums_in_cache_are_the_plain_ones():
    rng = np.random.default_rng(2)
    table = rng.standard_normal((900, 20)).astype(np.float32)
    rows, joins = rng.integers(0, 900, (1300, decontam.HALF)), rng.random(1300) < 0.5
    plain = table[rows].sum(1)
    want = plain.copy()
    want[:-1][joins[:-1]] += plain[1:][joins[:-1]]
    assert np.array_equal(decontam._pass(rows, joins, table), want)
    at, start = rng.integers(0, 900, 5000), np.unique(np.append(0, rng.integers(0, 5000, 700)))
    assert np.array_equal(decontam._sums(table, at, start), np.add.reduceat(table[at], start, axis=0))
    assert decontam._pass(rows[:0], joins[:0], table).shape == (0, 20)
