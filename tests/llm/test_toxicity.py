import zlib

import numpy as np

from codelake.llm import toxicity
from codelake.llm.boosting import calibrate, fit_isotonic, fit_trees
from codelake.llm.queries import op3_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op3_toxicity(spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().groupby("doc_id").toxic.max()
    own = got[got.held_out & got.doc_id.isin(labels.index)]
    y = own.doc_id.map(labels).to_numpy()
    pos, neg = own.score.to_numpy()[y == 1], own.score.to_numpy()[y == 0]
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.98
    assert (pos >= 0.5).mean() > 0.88 and (neg >= 0.5).mean() < 0.02


def test_obfuscation_counts():
    names = toxicity.FEATURES
    of = lambda t: dict(zip(names, toxicity.features(t, {}), strict=True))
    assert of("you are an idiot")["seed"] > 0 and of("you are an idiot")["near_you"] > 0
    assert of("you id1ot")["hidden"] == 1 and of("what an i.d.i.o.t here")["hidden"] == 1
    assert of("a plain text of words")["seed"] == 0
    assert of(None) == of("") and of("")["seed"] == 0
    assert of("STOP THIS NOW PLEASE")["shouted"] > 0


def test_no_labels(spark, odd, none, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(clashing(odd), labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    odd_labels = spark.createDataFrame([(4, 0, None), (None, 0, 1), (5, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, odd_labels).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = fit_trees(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.93
    knots = fit_isotonic(trees.margin(x[:1500]), y[:1500])
    assert (np.diff(knots[1]) >= 0).all()
    p = calibrate(np.linspace(-5, 5, 50), knots)
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def plain_margin(trees, row):
    total = trees.bias
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_query_against_plain_trees(spark):
    """Every score of a test table is that of trees walked row by row and a plain interpolation."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    at, p = model.knots
    for r in op3_toxicity(spark, sf).collect():
        m = plain_margin(model.trees, toxicity.features(texts[r["doc_id"]], model.lexicon))
        k = int(np.searchsorted(at, m))
        flat = p[0] if k == 0 else p[-1] if k == len(at) else p[k - 1] + (p[k] - p[k - 1]) * (m - at[k - 1]) / (at[k] - at[k - 1])
        want = min(1.0, max(0.0, 0.999 * flat + 0.001 / (1 + np.exp(-min(30, max(-30, m))))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


def test_first_split_is_the_best():
    """The root of the first tree has the largest gain of all features and cuts, its leaves Newton steps."""
    rng = np.random.default_rng(4)
    for _ in range(5):
        x = rng.integers(0, 6, (80, 3)).astype(float)
        y = (rng.random(80) < 1 / (1 + np.exp(2 - x[:, 1]))).astype(float)
        trees = fit_trees(x, y, rounds=1, depth=1)
        p = 1 / (1 + np.exp(-trees.bias))
        gain = lambda rows: (y[rows] - p).sum() ** 2 / (len(y[rows]) * p * (1 - p) + 2.0)
        options = {(j, c): gain(x[:, j] <= c) + gain(x[:, j] > c) for j in range(3) for c in np.unique(x[:, j])[:-1]}
        got = gain(x[:, trees.feature[0, 0]] <= trees.cut[0, 0]) + gain(x[:, trees.feature[0, 0]] > trees.cut[0, 0])
        assert got > max(options.values()) - 1e-9
        for side, leaf in ((x[:, trees.feature[0, 0]] <= trees.cut[0, 0], 0), (x[:, trees.feature[0, 0]] > trees.cut[0, 0], 1)):
            assert abs(trees.leaf[0, leaf] - 0.15 * (y[side] - p).sum() / (side.sum() * p * (1 - p) + 2.0)) < 1e-9


def test_isotonic_is_the_least_squares_fit():
    """Against the formula: the largest, over starts, of the smallest, over ends, of the means."""
    rng = np.random.default_rng(6)
    m, y = np.sort(rng.normal(size=60)), rng.integers(0, 2, 60).astype(float)
    at, p = fit_isotonic(m, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    blocks = sorted(set(np.round(want, 12)))
    assert np.allclose(sorted(set(np.round(p, 12))), blocks)
    for v, q in zip(at, p, strict=True):
        own = [m[i] for i in range(60) if abs(want[i] - q) < 1e-9]
        assert abs(np.mean(own) - v) < 1e-9


def test_equal_texts_get_equal_scores(spark):
    texts = ["you idiot", "a quiet day in the park"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len({(r["doc_id"] % 2, r["score"]) for r in rows}) == 2
