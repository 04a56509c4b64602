"""The non-negative risk against gradient descent, and the class prior against planted shares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.llm import quality


def table(spark, n, share, labelled, seed, gap=1.2):
    """(features, y) of `n` rows, of which `share` are positive and shifted in the first two features; and who is positive."""
    rng = np.random.default_rng(seed)
    positive = rng.random(n) < share
    x = rng.normal(size=(n, len(quality.FEATURES)))
    x[:, :2] += np.where(positive, gap, -gap)[:, None]
    y = np.where(positive & (rng.random(n) < labelled), 1, -1)
    return spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y, strict=True)], "features array<double>, y int"), x, y, positive


def descent(model, x, y, prior):
    """The least risk that plain gradient steps of falling length find."""
    at = model.bins(x)
    rows = np.zeros((len(x), len(model.weights)))
    rows[np.arange(len(x))[:, None], at] = 1
    pos, w, least = rows[y == 1], np.zeros(rows.shape[1]), np.inf
    loss = lambda z: np.log1p(np.exp(z))
    for k in range(6000):
        z, zp = rows @ w, pos @ w
        inside = loss(z).mean() - prior * loss(zp).mean()
        least = min(least, prior * loss(-zp).mean() + max(0, inside) + quality.RIDGE / 2 * w @ w)
        p, pp = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-zp))
        g = -prior * ((1 - pp) @ pos) / len(pos) + quality.RIDGE * w
        if inside > 0:
            g = g + p @ rows / len(rows) - prior * (pp @ pos) / len(pos)
        w = w - 2 / (1 + k / 100) * g
    return least


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.9])
def test_risk_is_least(spark, prior):
    """The maximum doesn't cut in at a prior of 0.05, lies at its bend at 0.3 and below it at 0.9."""
    rows, x, y, _ = table(spark, 400, 0.3, 0.5, 1)
    borders = [np.unique(np.quantile(x[:, k], np.arange(1, quality.BINS) / quality.BINS)) for k in range(x.shape[1])]
    start = quality.QualityModel(borders, np.zeros(len(quality.FEATURES) * quality.BINS + 1), prior, 0.0)
    model = quality.minimise(rows.repartition(2), start)
    want = descent(start, x, y, prior)
    at = lambda which: model.weights[model.bins(x[which])].sum(1)
    loss = lambda z: np.log1p(np.exp(z)).mean()
    inside = loss(at(slice(None))) - prior * loss(at(y == 1))
    risk = prior * loss(-at(y == 1)) + max(0, inside) + quality.RIDGE / 2 * model.weights @ model.weights
    assert model.risk == pytest.approx(risk, rel=1e-9)
    assert risk <= want * 1.01
    assert inside > 0 if prior == 0.05 else inside < 1e-3


@pytest.mark.parametrize("share", [0.25, 0.8])
def test_prior_is_read_from_unlabelled_rows(spark, share):
    rows, _, _, positive = table(spark, 6000, share, 0.3, 2, gap=2.0)
    features = rows.select(F.monotonically_increasing_id().alias("id"), "features", "y")
    features = quality.materialise(features, "test-features")
    labels = features.where("y = 1").select(F.col("id").alias("doc_id"), F.col("y").alias("quality"), F.lit(0).alias("features"))
    model = quality.train(features.drop("y"), labels, F.lit(False))
    assert abs(model.prior - positive.mean()) < 0.05


def test_best_bin():
    assert quality.best_bin(np.array([90.0, 10, 0]), np.array([450.0, 50, 500])) == pytest.approx(0.5)
    assert quality.best_bin(np.zeros(3), np.ones(3)) == 0.5
    assert 0 < quality.best_bin(np.array([0.0, 1]), np.array([1.0, 1])) < 1


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}", "f", 1, None, True) for k in range(9)] + [(None, None, None, None, None, None)], "doc_id long, text string, features string, y int, id long, first boolean")
    labels = spark.createDataFrame([(k, k % 2, "x", 0) for k in range(9)] + [(None, 1, None, None), (3, None, None, None)], "doc_id long, quality int, text string, y int")
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 10
