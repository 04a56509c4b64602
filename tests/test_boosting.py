"""Boosted states: better than the forest, calibrated on unseen rows, kept whole on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import boosting as bo
from tracetide.operators import scoring as sc
from tracetide.plans import scoring_queries as q

STATES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2400, 4))
    y = np.where(x[:, 0] * x[:, 1] > 0.4, "a", np.where(x[:, 2] + 0.5 * x[:, 0] > 0.3, "b", "c"))
    y = np.where(rng.random(2400) < 0.05, rng.choice(STATES, 2400), y)
    df = spark.createDataFrame([(i, str(y[i]), *map(float, x[i]), 1.0) for i in range(2400)], "row_id long, label string, f0 double, f1 double, f2 double, f3 double, same double")
    return df.repartition(4, "row_id").cache()


COLS = ["f0", "f1", "f2", "f3", "same"]


@pytest.fixture(scope="module")
def model(rows):
    return bo.train_boosted(rows.where("row_id % 4 > 0"), COLS, STATES)


def test_log_loss_is_below_the_forests(spark, rows, model):
    held = rows.where("row_id % 4 = 0")
    got = bo.boosted_probabilities(held, model)
    p = got.select([f"P_{s}" for s in STATES]).toPandas().to_numpy()
    assert p.sum(1) == pytest.approx(1) and p.min() >= 1e-12 and set(got.columns) == {*rows.columns, "P_a", "P_b", "P_c"}
    loss = bo.log_loss(got, STATES).first()
    forest = bo.log_loss(sc.state_probabilities(held, sc.train_states(rows.where("row_id % 4 > 0"), COLS, STATES)), STATES).first()
    assert loss.n == 600 and loss.log_loss < forest.log_loss
    assert (sc.argmax_label(got, STATES).where("label = pred_label").count()) / 600 > 0.85
    bins = got.select((F.col("P_a") * 5).cast("int").alias("b"), "P_a", (F.col("label") == "a").cast("int").alias("t")).groupBy("b").agg(F.avg("P_a").alias("p"), F.avg("t").alias("t"), F.count("t").alias("n")).where("n > 40")
    assert all(abs(r.p - r.t) < 0.2 for r in bins.collect())  # what is said to happen in a fifth of the cases does


def test_log_loss_on_the_stand_in(spark):
    df = q.baskets(spark, "/root/testdata/sf0.001").repartition(4, "row_id").cache()
    taught, held = df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0")
    loss = lambda p: bo.log_loss(p, STATES).first().log_loss
    mine = loss(bo.boosted_probabilities(held, bo.train_boosted(taught, q.BASKET, STATES)))
    assert mine < loss(sc.state_probabilities(held, sc.train_states(taught, q.BASKET, STATES)))


def test_importance_and_files(spark, rows, model, tmp_path):
    top = [r.feature for r in bo.boosted_importance(spark, model).collect()]
    assert set(top) == {"f0", "f1", "f2", "f3"} and top[-1] == "f3" and "same" not in model.cols
    bo.save_boosted(spark, model, str(tmp_path / "m"))
    again = bo.load_boosted(spark, str(tmp_path / "m"))
    cols = ["row_id", "P_a", "P_b", "P_c"]
    assert bo.boosted_probabilities(rows, again).select(cols).exceptAll(bo.boosted_probabilities(rows, model).select(cols)).count() == 0


def test_stratified_holdout_with_rising_curves(spark, rows):
    flag = bo.stratified(rows, "label", 0.15, 4)
    n = {r.label: (r.held / r.n) for r in rows.groupBy("label").agg(F.count_if(flag).alias("held"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(0.13 < x < 0.17 for x in n.values())
    one = bo.train_boosted(rows.where("row_id % 4 > 0"), COLS, STATES, holdout=0.15, isotonic=True, rounds=10)
    assert len(one.folds) == 1 and all(np.all(np.diff(b) >= 0) and np.all(np.diff(a) >= 0) for a, b in one.curves[0].values())
    got = bo.boosted_probabilities(rows.where("row_id % 4 = 0"), one)
    assert sc.argmax_label(got, STATES).where("label = pred_label").count() / 600 > 0.8


def test_states_that_are_missing(rows):
    with pytest.raises(ValueError):
        bo.train_boosted(rows.where("label <> 'c'"), COLS, STATES)
    with pytest.raises(ValueError):
        bo.train_boosted(rows.where("label <> 'c' or row_id = 2").union(rows.where("label = 'c'").limit(1)), COLS, STATES, folds=2)


def test_rows_that_repeat_are_one_row_of_the_fits(spark, rows, monkeypatch):
    few = rows.select("label", *[(F.round(c) / 1).alias(c) for c in COLS], F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), (F.col("row_id") * 5 + F.col("k")).alias("row_id"))
    fitted = []
    real = bo.GBTClassifier.fit
    monkeypatch.setattr(bo.GBTClassifier, "fit", lambda self, df: fitted.append((df.count(), df.agg(F.sum("weight")).first()[0])) or real(self, df))
    one = bo.train_boosted(few, COLS, STATES, rounds=2, folds=2)
    n = few.select("label", *COLS).distinct().count()
    assert len(fitted) == 6 and all(k <= n < 12_000 / 4 for k, _ in fitted)
    assert sum(w for _, w in fitted) == pytest.approx(3 * 12_000)  # every row counts in all folds but its own
    assert all(a < b for own in one.cuts for a, b in zip(own, own[1:]))


def test_bins_end_at_their_cuts(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 3, 3, 7)], "x double")
    assert bo.feature_cuts(df.withColumn("s", F.col("x") > 2), ["x"], "s") == [[1.0, 2.0, 3.0]]
    got = {r.x: r.b0 for r in bo.binned(df, ["x"], [[1.0, 2.0, 3.0]], "b").collect()}
    assert got == {1.0: 0.0, 2.0: 1.0, 3.0: 2.0, 7.0: 3.0}
