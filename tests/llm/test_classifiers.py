import random
import zlib

import numpy as np
import pytest
from data_llm import DOCS

from kandle.llm import nbsvm, toxicity as tx
from kandle.llm.labelled import fold, sample

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def small(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held(report, labels, col):
    rows = report.where("held_out").join(labels, "doc_id").select("score", "predicted", col).collect()
    return np.array([[r[0], r[1], r[2]] for r in rows], float)


def test_quality_on_held_out(small):
    docs, labels = small
    got = held(nbsvm.report(docs, labels), labels, "quality")
    assert len(got) > 50 and (got[:, 1] == got[:, 2]).mean() > 0.93
    assert got[got[:, 2] == 1, 0].mean() > got[got[:, 2] == 0, 0].mean() + 0.5


def test_toxicity_on_held_out(small):
    docs, labels = small
    got = held(tx.report(docs, labels), labels, "toxic")
    assert (got[:, 1] == got[:, 2]).mean() > 0.93 and ((got[:, 1] == 1) & (got[:, 2] == 0)).sum() <= 1


@pytest.mark.parametrize("op,col", [(nbsvm, "quality"), (tx, "toxic")])
def test_edges(edge, none, spark, op, col):
    """Null texts and ids, repeated rows and labels, no labels, one class."""
    n = edge.count()
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (5, None, None), (10 ** 6, 1, 1)], LABELS)
    got = op.report(edge, labels).collect()
    assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    for lab in (labels.limit(0), labels.where(f"{col} = 1")):
        got = op.report(edge, lab).collect()
        assert len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] < 1
    assert op.report(none, labels).collect() == []
    assert DOCS.names[0] == "doc_id" and fold("doc_id") is not None


def test_learns_nothing_from_held_out_rows(small):
    from pyspark.sql import functions as F
    docs, labels = small
    flipped = labels.withColumn("quality", F.when(fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in nbsvm.report(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in nbsvm.report(docs, flipped).collect()}


def test_isotonic_rises_and_trees_learn():
    rng = np.random.default_rng(3)
    m = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    xs, ps = tx.isotonic(m, y)
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all()
    x = rng.normal(size=(600, 4))
    t = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = tx.fit_trees(x, t, tx.ToxicityConfig())
    assert ((model.margin(x) > 0) == (t > 0)).mean() > 0.97


def test_dual_coordinate_descent_finds_the_optimum():
    """The duality gap closes on random data."""
    rng = np.random.default_rng(1)
    conf = nbsvm.NbsvmConfig(dims=40, epochs=2000)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    r = rng.normal(size=40)
    w, b = nbsvm.dual_coordinate_descent(rows, r, y, conf)
    xs = [r[i] / (np.sqrt((r[i] ** 2).sum()) or 1) for i in rows]
    cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))

    def value(w, b):
        return (w @ w + b * b) / 2 + sum(c * max(0, 1 - t * (w[i] @ v + b)) for c, t, i, v in zip(cost, y, rows, xs))

    best = value(w, b)
    for _ in range(300):
        assert value(w + rng.normal(size=40) * 0.02, b + rng.normal() * 0.02) >= best - 1e-3


def test_features_see_insults(spark):
    lex = {w: 2.0 for w in tx.SEED_LEXICON}
    f = dict(zip(tx.FEATURES, tx.features("You are an IDIOT!!! such an id1ot and st*pid soooo", lex)))
    assert f["seed_density"] > 0 and f["near_you"] > 0 and f["masked"] > 0 and f["stretched"] > 0 and f["exclaim"] > 0
    assert tx.features(None, lex) == tx.features("", lex) == [0.0] * len(tx.FEATURES)
    assert random.Random(1).random() < 1


def test_sample_is_bounded_for_any_size(spark):
    rows = spark.range(3000).selectExpr("id", "concat('t', id) AS text", "1 AS y")
    assert 240 < sample(rows, 3000, 300).count() < 360
    hot = rows.where("id < 2000").unionAll(spark.range(1000).selectExpr("7L AS id", "'hot' AS text", "0 AS y"))
    got = {}
    for seed in range(4):
        drawn = sample(hot, 3000, 300, seed).collect()
        got[seed] = sum(r["text"] == "hot" for r in drawn)
        assert 240 < len(drawn) < 360 and drawn[0].asDict().keys() == {"id", "text", "y"}
    assert set(got.values()) <= {100, 101}
    many = sample(rows, 40 * 10 ** 9, 8_000 * 10 ** 4)  # 2 of 1,000
    assert 0 < many.count() < 20
    # more than a million rows to one wanted: still drawn at the full resolution of the hash
    tiny = spark.range(20_000_000).selectExpr("id", "'x' AS text", "1 AS y")
    assert 0 < sample(tiny, 40 * 10 ** 9, 20_000).count() < 30
