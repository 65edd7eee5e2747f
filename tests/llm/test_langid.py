import zlib

import numpy as np

from codelake.llm import langid
from codelake.llm.queries import op4_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op4_langid(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(both) == len(truth) and both.score.between(0, 1).all()
    assert (both.held_out == both.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.98


def grams(text, orders=4):
    """Sets of slots by order."""
    return [set(s.tolist()) for s in langid.slots(text, orders, 16)]


def kernel(x, y):
    return sum(len(a & b) / np.sqrt(len(a) * len(b)) for a, b in zip(x, y, strict=True) if a and b)


def plain_scores(train, langs, tests, landmarks=160, least=8, ridge=1e-2):
    """Outputs of weighted ridge regression on the Nyström map, from kernel values alone."""
    names, seen, rank = sorted(set(langs)), {}, []
    for x in langs:
        seen[x] = seen.get(x, 0) + 1
        rank.append(seen[x])
    marks = [train[i] for i in sorted(range(len(train)), key=lambda i: (rank[i], i))[: max(landmarks, least * len(names))]]
    kmm = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi, new = (np.array([[kernel(x, m) for m in marks] for x in rows]) @ root for rows in (train, tests))
    w = np.array([len(train) / len(names) / langs.count(x) for x in langs])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    mean, shift = (w @ phi) / w.sum(), (w @ y) / w.sum()
    penalty = np.sqrt(ridge * len(train) * np.trace(kmm) / len(marks) * 0.01)
    left = np.vstack([(phi - mean) * np.sqrt(w)[:, None], penalty * np.eye(phi.shape[1])])
    right = np.vstack([(y - shift) * np.sqrt(w)[:, None], np.zeros((phi.shape[1], len(names)))])
    return names, (new - mean) @ np.linalg.lstsq(left, right, rcond=None)[0] + shift


def test_folded_weights_equal_the_kernel():
    """Presence times folded weights is the kernel with the landmarks times the dual weights."""
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "a cat sat there", "un chien noir", "ein hund war da"] * 3
    texts = [t + " " + "xyz"[k % 3] * (k % 5) for k, t in enumerate(texts)]
    langs = ["en", "fr", "de"] * 6
    tests = ["the dog", "le chien", "die katze", "zzz", "the chat katze", ""]
    for landmarks, least in ((3, 1), (9, 2), (40, 8)):
        model = langid.fit(texts, langs, landmarks=landmarks, least=least)
        out = model.decide(tests)
        names, want = plain_scores([grams(t) for t in texts], langs, [grams(t) for t in tests], landmarks, least)
        assert model.langs == names and np.abs(out - want).max() < 1e-3
        assert landmarks == 3 or [model.langs[k] for k in out[:3].argmax(1)] == ["en", "fr", "de"]
    a, b = langid.slots("abcab", 2, 16), langid.slots("cabx", 2, 16)
    assert len(a[0]) == 3 and len(a[1]) == 3 and len(np.intersect1d(a[1], b[1])) == 2


def test_query_against_plain_kernels(spark):
    """A whole test table: every prediction is that of kernel values and a plain ridge regression."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    fold = docs.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    usable = docs[~fold & docs.lang.notna() & docs.text.map(lambda t: langid.has_letter(t))]
    hashed = spark.createDataFrame([(int(i), t) for i, t in zip(usable.doc_id, usable.text, strict=True)], "doc_id long, text string").selectExpr("doc_id", "xxhash64(text, 5) as h").toPandas()
    train = usable.merge(hashed, on="doc_id").drop_duplicates(["lang", "h"]).sort_values(["lang", "h"])
    some = docs[docs.text.map(lambda t: langid.has_letter(t))]
    names, scores = plain_scores([grams(t) for t in train.text], train.lang.tolist(), [grams(t) for t in some.text])
    want = dict(zip(some.doc_id, scores, strict=True))
    for r in op4_langid(spark, sf).collect():
        if r["doc_id"] not in want:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        s = want[r["doc_id"]]
        top = np.sort(s)[::-1]
        assert r["lang_pred"] == names[s.argmax()] or top[0] - top[1] < 2e-3
        e = np.exp(3 * (s - s.max()))
        assert abs(r["score"] - 1 / e.sum()) < 5e-3


def test_ties_and_many_languages(spark):
    """Equal texts under two languages: the first by name; every language has landmarks."""
    docs = [(k, "same words here", lang) for k, lang in enumerate(["bb", "aa"] * 10)]
    got = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"aa"} and len({r["score"] for r in got}) == 1
    rng = np.random.default_rng(0)
    texts, langs = [], []
    for k in range(200):
        letters = [chr(c) for c in rng.integers(0x4E00, 0x9000, 30)]
        for _ in range(3):
            texts.append(" ".join("".join(rng.choice(letters, 4)) for _ in range(12)))
            langs.append(f"l{k:03d}")
    model = langid.fit(texts, langs, landmarks=16, least=2)
    own = model.decide(texts).argmax(1)
    assert np.mean([model.langs[k] == x for k, x in zip(own, langs, strict=True)]) > 0.98


def test_odd_rows(spark, odd, none, clashing):
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(clashing(odd)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows
    assert langid.identify(odd).count() == odd.count()
    assert langid.identify(none).count() == 0
    assert not langid.has_letter("12 ,.!") and langid.has_letter("1 ñ") and langid.has_letter("东")


def test_nothing_to_learn(spark, odd):
    from pyspark.sql import functions as F

    rows = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
