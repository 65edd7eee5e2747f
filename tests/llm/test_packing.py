import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelake.llm import packing, words
from codelake.llm.queries import op1_packing, tokenizer_path
from codelake.llm.words import encode


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def reference_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, docs, window):
    """Every id lies in one piece, sequences are gapless, and full or of a power of two."""
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in by_seq.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at == window or at < window and at & (at - 1) == 0
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], list(np.frombuffer(p["ids"], "<u4"))))
        assert len(p["ids"]) == 4 * p["length"]
    for doc, text in docs:
        ids, at = [], 0
        for start, part in sorted(by_doc[doc]):
            assert start == at
            at += len(part)
            ids += part
        assert ids == reference_ids(text)


@given(st.text(max_size=60))
@settings(max_examples=120, deadline=None)
def test_ids_are_those_of_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [*encode(tokenizer_path(), text), 0] == reference_ids(text)


@pytest.mark.parametrize("window", [16, 64, 1024])
def test_round_trip(spark, window):
    docs = [(i, "word " * (i * 7 % 90) + "x") for i in range(120)] + [(500, None), (501, ""), (502, "a b <|endoftext|> c" * 700)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), tokenizer_path(), window).collect()
    check(rows, docs, window)


def test_same_length_for_all(spark):
    docs = [(i, "one two three") for i in range(400)]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), tokenizer_path(), 32).collect(), docs, 32)


def test_odd_rows(spark, odd, none, clashing):
    rows = packing.pack(clashing(odd), tokenizer_path(), 64).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 2 * len(reference_ids("one two three four five six seven"))
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 2 * len(reference_ids("a text without an id that is long enough to count"))
    assert packing.pack(none, tokenizer_path(), 64).count() == 0


def test_ids_over_two_bytes(spark, tmp_path):
    """The width of ids is read from the tokenizer's file."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    wide = Tokenizer(models.WordLevel({f"w{n}": n for n in (1, 65_535, 65_536, 70_001)} | {"?": 2}, unk_token="?"))
    wide.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "wide.json")
    wide.save(path)
    assert words.vocabulary_size(path) == 70_002 and words.vocabulary_size(tokenizer_path()) == 50_257
    docs = spark.createDataFrame([(1, "w70001 w65536 w1 w65535 other"), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["start"] + k): int(v) for r in packing.pack(docs, path, 4).collect() for k, v in enumerate(np.frombuffer(r["ids"], "<u4"))}
    assert [got.pop((1, k)) for k in range(6)] == [70_001, 65_536, 1, 65_535, 2, 0] and got == {(2, 0): 0}


def test_query(spark):
    got = op1_packing(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: np.array(reference_ids(r["text"]), "<u4") for r in docs}
    for p in got.itertuples():
        assert p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(i) for d, i in ids.items()}
    full = got.groupby("sequence_id").length.sum()
    assert ((full == 1024) | (full & (full - 1) == 0)).all() and (full < 1024).sum() <= 10


def test_plan_prefers_whole_tails():
    """Most tails of a smooth histogram are placed uncut by combinations."""
    hist = np.zeros(256, np.int64)
    hist[1:] = 50
    plan = packing.make_plan(hist, 256)
    assert plan.planned.sum() > 0.8 * hist.sum()
    seen = defaultdict(int)
    for n in range(1, 256):
        for rank in range(50):
            for _, take, seq, off in plan.pieces(n, rank):
                assert off + take <= 256
                seen[seq] += take
    assert all(v == 256 or v & (v - 1) == 0 for v in seen.values()) and len(seen) == plan.sequences


def test_nnls_is_optimal():
    """No positive count can move and no zero count can grow without a larger error."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        hist = np.zeros(64, np.int64)
        hist[rng.choice(np.arange(1, 64), 12, replace=False)] = rng.integers(1, 60, 12)
        combos, times = packing.combinations(np.flatnonzero(hist), 64, 3)
        assert ((combos * times).sum(1) == 64).all()
        x = packing.solve_nnls(combos, times, hist.astype(float))
        assert (x >= 0).all()
        a = np.zeros((64, len(combos)))
        for j, (c, t) in enumerate(zip(combos, times, strict=True)):
            np.add.at(a[:, j], c[c > 0], t[c > 0])
        gradient = a.T @ ((np.arange(64) / 64 + 0.05) * (hist - a @ x))
        assert (np.abs(gradient[x > 1e-6]) < 1e-2).all() and (gradient[x <= 1e-6] < 0.1).all()


@pytest.mark.parametrize("kind", ["log-normal", "short"])
def test_plan_places_short_tails(kind):
    """Tails too short for three of them to fill a window are repeated in it."""
    rng = np.random.default_rng(3)
    lengths = np.exp(rng.normal(4.5, 1, 60_000)).astype(int) if kind == "log-normal" else rng.integers(1, 40, 60_000)
    hist = np.bincount(lengths[(lengths > 0) & (lengths < 1024)], minlength=1024)[:1024]
    assert packing.make_plan(hist, 1024).planned.sum() > 0.8 * hist.sum()


def test_vocabulary_has_one_order_of_merges():
    """The conditions under which merging by smallest id gives the ids of the library: ids are the
    merges' order, and each token is its own encoding."""
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        vocabulary = json.load(f)
    assert words.byte_ranks(vocabulary)
    model = library().model
    special = {t["content"] for t in vocabulary["added_tokens"]}
    assert all(len(model.tokenize(t)) == 1 for t in vocabulary["model"]["vocab"] if t not in special)


def test_all_characters_split_alike():
    """Every code point, between letters, digits, marks and blanks, gives the ids of the library."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 50_000):
        text = " ".join(f"a{c}b{c}{c}1{c}! {c}" for c in points[lo : lo + 50_000])
        assert library().encode(text, add_special_tokens=False).ids == encode(tokenizer_path(), text).tolist()


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r\n", " \n", "\u3000", "\x1c", "\x85"])
@pytest.mark.parametrize("before, after", [("", ""), ("a", "b"), ("a ", " b"), ("1", "!"), ("x", ""), ("", "'s")])
def test_long_blanks(blank, before, after):
    for n in (999, 1000, 1001, 2003):
        text = before + blank * n + after
        assert [*encode(tokenizer_path(), text), 0] == reference_ids(text)
        text = text + "word" + text
        assert [*encode(tokenizer_path(), text), 0] == reference_ids(text)


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a", "7", ".", "é", " x"])
def test_very_long_texts(unit):
    text = "start " + unit * 300_000 + "end"
    assert [*encode(tokenizer_path(), text), 0] == reference_ids(text)


def test_very_long_blanks_in_a_job(spark, monkeypatch):
    docs = [(1, " " * 5_000_000), (2, "a" + "\n" * 5_000_000 + "b"), (3, "\t" * 1_000_000 + " x"), (4, "one")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer_path(), 1024).select("doc_id", "start", "length", "doc_tokens")
    got = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(r["n"] == r["t"] for r in got) and {r["doc_id"]: r["n"] for r in got}[1] == 5_000_001


def test_blocks_are_bounded(spark, monkeypatch):
    """A text longer than a block is handed over in parts."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 100)
    text = "some words of a longer text " * 200
    run = packing._tokenise(tokenizer_path(), 16, 0, True)
    docs = [(1, text), (2, None), (3, "short"), (4, text)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 7})())
    out = list(run([batch]))
    assert len(out) > 4
    rows = [r for b in out for r in b.to_pylist()]
    for doc, text in docs:
        got = sorted((r["start"], np.frombuffer(r["ids"], "<u2").tolist()) for r in rows if r["doc_id"] == doc)
        assert [i for _, part in got for i in part] == reference_ids(text)
    assert len({(r["length"], r["nth"]) for r in rows}) == len(rows)


def test_crc_column_is_unsigned(spark):
    row = spark.sql("select crc32(X'00000000') as c").select(F.col("c")).first()
    assert row["c"] == zlib.crc32(b"\0\0\0\0")
