from collections import Counter

from codelake.llm import token_rollup as tr
from codelake.llm.queries import op7_token_counts, tokenizer_path
from codelake.llm.words import encode


def rows(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in df.collect()}


def test_batches(spark, tmp_path):
    frame = lambda x: spark.createDataFrame(x, tr.CHANGE)
    r = tr.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    add = frame([("insert", 1, "a", "en", "v1", 10, None, None, None, None), ("insert", 2, "a", None, "v1", 5, None, None, None, None), ("insert", 3, "b", "en", "v1", None, None, None, None, None)])
    assert r.commit("one", add) and not r.commit("one", add)
    assert rows(r.totals()) == {("a", "en", "v1"): (1, 10), ("a", None, "v1"): (1, 5), ("b", "en", "v1"): (1, 0)}
    assert r.commit("two", frame([("revise", 1, "a", "en", "v2", 12, "a", "en", "v1", 10), ("delete", 2, "a", None, "v1", None, None, None, None, 5)]))
    assert rows(r.totals()) == {("a", "en", "v2"): (1, 12), ("b", "en", "v1"): (1, 0)}
    assert tr.Rollup(spark, f"file://{tmp_path}/r").committed().keys() == {"one", "two"}
    assert r.commit("empty", frame([])) and rows(r.totals()) == {("a", "en", "v2"): (1, 12), ("b", "en", "v1"): (1, 0)}


def test_second_writer_loses(spark, tmp_path):
    """Two writers that both found no batch: the rename lets one through."""
    r = tr.Rollup(spark, f"file://{tmp_path}/r")
    add = spark.createDataFrame([("insert", 1, "a", "en", "v1", 10, None, None, None, None)], tr.CHANGE)
    other = tr.Rollup(spark, f"file://{tmp_path}/r")
    other.committed = dict
    assert r.commit("x", add) and not other.commit("x", add)
    assert rows(r.totals()) == {("a", "en", "v1"): (1, 10)}


def test_compaction(spark, tmp_path):
    r = tr.Rollup(spark, f"file://{tmp_path}/r")
    add = lambda n: spark.createDataFrame([("insert", n, "a", "en", "v1", n, None, None, None, None)], tr.CHANGE)
    assert not r.compact()
    assert r.commit("one", add(1)) and r.commit("two", add(2))
    assert r.compact() and not r.compact()
    assert not r.commit("one", add(1)) and rows(r.totals()) == {("a", "en", "v1"): (2, 3)}
    assert len(r._sources()[1]) == 1
    assert r.commit("three", add(4)) and rows(r.totals()) == {("a", "en", "v1"): (3, 7)}
    late = tr.Rollup(spark, f"file://{tmp_path}/r")
    late._snapshot = lambda: (0, [], set())  # looked before the first snapshot was there
    assert not late.compact() and rows(r.totals()) == {("a", "en", "v1"): (3, 7)}
    assert r.compact() and rows(r.totals()) == {("a", "en", "v1"): (3, 7)}
    assert r.commit("back", spark.createDataFrame([("delete", n, "a", "en", "v1", None, None, None, None, n) for n in (1, 2, 4)], tr.CHANGE))
    assert r.compact() and rows(r.totals()) == {}


def test_further_corpus_in_a_rollup(spark, tmp_path, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    path = f"file://{tmp_path}/r"
    load = lambda name: rows(tr.corpus_rollup(odd, labels, tokenizer_path(), path, name))
    once = brute(docs, set())
    assert load("a") == once and load("a") == once
    assert load("b") == {k: (2 * n, 2 * t) for k, (n, t) in once.items()}


def test_unknown_op(spark, tmp_path):
    import pytest

    bad = spark.createDataFrame([("upsert", 1, "a", "en", "v1", 10, None, None, None, None)], tr.CHANGE)
    with pytest.raises(Exception, match="unknown op"):
        tr.Rollup(spark, f"file://{tmp_path}/r").commit("bad", bad)


def brute(docs, bad):
    words, bpe = Counter(), Counter()
    n_words, n_bpe = Counter(), Counter()
    for d, t, lang, source in docs:
        if d in bad:
            continue
        words[source, lang or "und", "words"] += sum(any(c.isalnum() or c == "_" for c in w) for w in (t or "").split())
        bpe[source, lang, "bpe"] += len(encode(tokenizer_path(), t))
        n_words[source, lang or "und", "words"] += 1
        n_bpe[source, lang, "bpe"] += 1
    return {k: (v, (words + bpe)[k]) for k, v in (n_words + n_bpe).items()}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    assert rows(op7_token_counts(spark, sf)) == brute(docs, bad)


def test_marks():
    assert tr.MARKS.findall("a | b -- c- -d ...\n| é 🙂 _") == ["|", "--", "...", "|", "🙂"]


def test_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(5, 0, 0), (None, 0, 0), (5, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert rows(tr.corpus_rollup(clashing(odd), labels, tokenizer_path())) == brute(docs, {5})
    assert tr.corpus_rollup(none, labels, tokenizer_path()).count() == 0
