"""The pipeline against brute force on small documents with planted cases."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from .test_line_dedup import key
from .test_minhash import brute as near_groups
from .test_packing import check


@pytest.fixture(scope="module")
def folder(tmp_path_factory, vocabulary):
    rng = random.Random(9)
    out = tmp_path_factory.mktemp("sf")
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(30) for _ in range(12)]
    docs, labels = [], []
    shared = "This very line stands in many documents"
    for d in range(400):
        body = [text(40) for _ in range(rng.randint(1, 4))]
        if d % 10 == 3:
            body.insert(1, "you stupid idiot, you are a pathetic moron " + text(10))
        if d % 20 == 5:
            body.append(items[d // 20 % 12])
        if d % 7 == 0:
            body.append(shared)
        docs.append((d, "\n".join(body)))
        if d % 2:
            labels.append((d, 1, int(d % 10 == 3)))
    for d in range(400, 440):
        docs.append((d, docs[(d - 400) * 2 + 1][1]))
    docs += [(500, None), (501, "")]
    pq.write_table(pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": [len(t or "") for _, t in docs]}), out / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [d for d, _, _ in labels], "quality": pa.array([q for _, q, _ in labels], pa.int32()), "toxic": pa.array([t for _, _, t in labels], pa.int32())}), out / "labels.parquet")
    pq.write_table(pa.table({"item_id": list(range(12)), "text": items}), out / "benchmark.parquet")
    return out, docs, items, shared


def test_stages(spark, folder):
    out, docs, items, shared = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    now = spark.read.parquet(f"{out}/documents.parquet")
    columns, results = now.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{out}/stage-{n}"
        stage(spark, now, str(out)).write.parquet(path)
        now = spark.read.parquet(path)
        results[name] = now.collect()
        if name != "packing":
            assert now.columns == columns
    toxic = {d for d, t in docs if "pathetic moron" in (t or "")}
    clean = {d for d, _ in docs} - toxic
    left = {r["doc_id"]: r["text"] for r in results["toxicity"]}
    assert set(left) == clean
    holders = [d for d, t in left.items() if key(shared) in map(key, (t or "").split("\n"))]
    lines = {r["doc_id"]: r["text"] for r in results["line_dedup"]}
    assert [d for d, t in lines.items() if shared in t] == [max(holders)]
    near = {r["doc_id"]: r["text"] for r in results["near_dedup"]}
    assert set(near) == {d for d, _, _, kept in near_groups(sorted(lines.items())) if kept} and len(near) < len(lines)
    leaked = {d for d, t in near.items() if any(i in (t or "") for i in items)}
    rest = {r["doc_id"]: r["text"] for r in results["decontamination"]}
    assert set(rest) == set(near) - leaked and leaked
    check(results["packing"], sorted(rest.items()), 1024)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, str(folder[0])).toPandas()
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    assert np.array_equal(got.ids.map(len).to_numpy(), 4 * got.length.to_numpy())


def test_odd_rows(spark, folder, odd, none, clashing):
    """Every filtering stage keeps the columns, whatever their names, and the rows it has no reason to drop."""
    docs = clashing(odd).withColumnsRenamed({"score": "nth", "rank": "rest", "key": "row"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(folder[0]))
        assert got.columns == docs.columns
        assert got.count() == docs.count() - (name == "near_dedup") * 2
        assert stage(spark, none, str(folder[0])).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(folder[0])).filter("doc_id = 1").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(folder[0])).count() == 0


def test_near_copies_under_one_id(spark, folder, vocabulary):
    """Different texts under one doc_id both stay, equal rows and linked texts stay once."""
    rng = random.Random(2)
    a, b = (" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(2))
    rows = [(5, a), (5, b), (5, b), (7, a + " x y"), (9, b + " x y"), (None, a), (None, a), (8, ""), (8, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, str(folder[0])).collect()), key=str)
    assert [x for x in got if x[0] != 8] == sorted([(5, a), (5, b), (None, a), (None, a)], key=str)
    assert len([x for x in got if x[0] == 8]) == 1
