"""Sessions from made recordings to bouts: states are found, tables agree, publishing is done once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import sessions as se

FS, FV, LONG = 64.0, 10.0, 120
#: Dominant Hz and diameter of each state.
LOOKS = {"NREM": (2.0, 1.0), "REM": (7.0, 0.6), "Wake": (20.0, 2.0)}
PLAN = se.Plan(FS, FV, 2.0, context_windows=(3, 7), median_s={s: 20.0 for s in LOOKS}, sigma={s: 1.0 for s in LOOKS}, longest_s=80.0)


def made(spark, ids):
    rng = np.random.default_rng(1)
    samples, eye, whisk, labels = [], [], [], []
    for sid in ids:
        cuts = [0, *np.sort(rng.choice(np.arange(10, LONG - 10, 10), 5, replace=False)).tolist(), LONG]
        order = [list(LOOKS)[(k + len(sid)) % 3] for k in range(6)]
        state = lambda t: order[np.searchsorted(cuts, t, "right") - 1]  # noqa: B023, E731
        labels += [(sid, s, float(a), float(b)) for s, a, b in zip(order, cuts, cuts[1:], strict=False)]
        for i in range(int(LONG * FS)):
            t = i / FS
            hz, _ = LOOKS[state(t)]
            samples.append((sid, t, float(3 * np.sin(2 * np.pi * hz * t) + rng.normal())))
        for i in range(int(LONG * FV)):
            t = i / FV
            size = LOOKS[state(t)][1]
            eye.append((sid, i, size + 0.05 * float(rng.normal()), abs(float(rng.normal())) * size, 1.0, 0.9))
            whisk.append((sid, i, t, float(rng.normal() ** 2)))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(4).cache()
    return frame(samples, "session_id string, t double, value double"), frame(eye, "session_id string, frame long, diameter double, motion double, eyelid double, eyelid_norm double"), frame(whisk, "session_id string, frame long, t double, whisking double"), frame(labels, "session_id string, label string, l_start double, l_end double")


@pytest.fixture(scope="module")
def parts(spark):
    return made(spark, ["a", "bb", "ccc"])


@pytest.fixture(scope="module")
def session(parts):
    return se.assemble(*parts[:3])


@pytest.fixture(scope="module")
def model(session, parts):
    two = se.Session(*(d.where("session_id <> 'ccc'") for d in session))
    return se.train_sessions(two, parts[3].withColumn("label", F.when(F.col("label") == "NREM", "nrem_sws ").otherwise(F.col("label"))), PLAN, folds=2, rounds=4)


@pytest.fixture(scope="module")
def scored(session, model):
    got = se.score_sessions(session, model, PLAN)
    return se.Scored(got.epochs.cache(), got.bouts.cache())


def test_assembly(spark, parts):
    voltage, eye, whisk, _ = parts
    bounds = spark.createDataFrame([("a", 10.0, 30.0), ("bb", None, 50.0)], "session_id string, t0 double, t1 double")
    got = se.assemble(voltage, eye.where("frame < 500").withColumn("lid_likelihood", F.lit(0.4)), whisk, bounds)
    ends = {r.session_id: (r.a, r.b) for r in got.samples.groupBy("session_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()}
    assert ends["a"] == (10.0, 30.0) and ends["bb"] == (0.0, 50.0) and ends["ccc"][1] > 119
    one = got.frames.where("session_id = 'a' and frame = 7").first()
    assert (one.pup_likelihood, one.lid_likelihood, one.t) == (1.0, 0.4, 0.7) and got.frames.where("session_id = 'a'").count() == 500
    grid = se.session_epochs(got, 2.0).groupBy("session_id").agg(F.min("e_start").alias("a"), F.max("e_end").alias("b")).collect()
    assert {r.session_id: (r.a, r.b) for r in grid} == {"a": (10.0, 30.0), "bb": (0.0, 48.0), "ccc": (0.0, 48.0)}
    assert se.session_epochs(se.Session(got.samples, got.frames.where("session_id = 'a'")), 2.0).select("session_id").distinct().count() == 1


def test_states_of_a_session_not_taught(scored, parts):
    epochs, truth = scored.epochs.where("session_id = 'ccc'").toPandas().sort_values("epoch_idx"), parts[3].where("session_id = 'ccc'").toPandas()
    own = [next(r.label for r in truth.itertuples() if r.l_start <= m < r.l_end) for m in (epochs["start_s"] + epochs["end_s"]) / 2]
    assert len(epochs) == 59 and (epochs["pred_label"] == own).mean() > 0.85
    assert epochs[["P_NREM", "P_REM", "P_Wake"]].sum(axis=1).to_numpy() == pytest.approx(1)
    bouts = scored.bouts.where("session_id = 'ccc'").toPandas().sort_values("start_s")
    assert (bouts["start_s"].to_numpy()[1:] == bouts["end_s"].to_numpy()[:-1]).all() and bouts["n_epochs"].sum() == 59
    assert (bouts["label"].to_numpy()[1:] != bouts["label"].to_numpy()[:-1]).all()
    first = bouts.iloc[0]
    inside = epochs[epochs["start_s"] < first["end_s"]]
    assert first["mean_P_REM"] == pytest.approx(inside["P_REM"].mean()) and first["mean_pupil_share"] == pytest.approx(1)


def test_two_interval_tables(scored):
    bouts, likely = se.hypnograms(scored, PLAN)
    assert bouts.where("session_id = 'a'").count() == scored.bouts.where("session_id = 'a'").count()
    rows = likely.where("session_id = 'a'").toPandas().sort_values("start_time")
    top = scored.epochs.where("session_id = 'a'").toPandas().sort_values("epoch_idx")
    states = top[["P_NREM", "P_REM", "P_Wake"]].to_numpy().argmax(1)
    assert len(rows) == 1 + (states[1:] != states[:-1]).sum() and rows["end_time"].max() == top["end_s"].max()


def test_evaluation_of_two_sessions(spark):
    """One epoch of six wrong, by epochs and by time; a session without labels isn't judged."""
    states = ["NREM", "NREM", "REM", "Wake", "Wake", "Wake"]
    own = lambda sid, states: [(sid, k, float(k), k + 1.0, s, *[0.8 if s == x else 0.1 for x in LOOKS]) for k, s in enumerate(states)]
    epochs = spark.createDataFrame(own("a", states) + own("b", ["REM"] * 6) + own("c", states), "session_id string, epoch_idx long, start_s double, end_s double, pred_label string, P_NREM double, P_REM double, P_Wake double")
    bouts = spark.createDataFrame([("a", 0.0, 2.0, "NREM"), ("a", 2.0, 3.0, "REM"), ("a", 3.0, 6.0, "Wake"), ("b", 0.0, 6.0, "REM"), ("c", 0.0, 6.0, "Wake")], "session_id string, start_s double, end_s double, label string")
    labels = spark.createDataFrame([("a", "NREM_SWS", 0.0, 2.0), ("a", "REM", 2.0, 4.0), ("a", "Artifact", 4.0, 5.0), ("a", "Wake", 5.0, 6.0), ("b", "R", 0.0, 4.5), ("b", "unknown", 4.5, 6.0)], "session_id string, label string, l_start double, l_end double")
    got = se.evaluate_sessions(se.Scored(epochs, bouts), labels, se.Plan(FS))
    for table in (got.epoch_metrics, got.bout_metrics):
        assert {r.session_id: r.accuracy for r in table.collect()} == {"a": pytest.approx(5 / 6), "b": 1.0}
    rem = got.bout_metrics.where("session_id = 'a' and label = 'REM'").first()
    assert (rem.support, rem.precision, rem.recall) == (2.0, 1.0, 0.5)
    assert [tuple(r) for r in got.epoch_mismatches.collect()] == [("a", 3.0, 4.0, "REM", "Wake")]
    assert [tuple(r) for r in got.bout_mismatches.collect()] == [("a", 3.0, 4.0, 1.0, "REM", "Wake")]
    purity = {(r.session_id, r.p_start): (r.dominant, r.purity) for r in got.purity.collect()}
    assert purity["a", 3.0] == ("Wake", pytest.approx(2 / 3)) and purity["b", 0.0] == ("REM", 1.0)


def test_published_once(spark, session, model, tmp_path):
    out = str(tmp_path / "o")
    one = se.Session(*(d.where("session_id = 'a'") for d in session))
    assert [(r.session_id, r.status, r.n_epochs) for r in se.publish_scores(spark, one, model, PLAN, out).collect()] == [("a", "scored", 59)]
    two = se.Session(*(d.where("session_id <> 'ccc'") for d in session))
    assert {(r.session_id, r.status) for r in se.publish_scores(spark, two, model, PLAN, out).collect()} == {("a", "kept"), ("bb", "scored")}
    assert se.publish_scores(spark, two, model, PLAN, out).where("status = 'scored'").count() == 0
    assert se.read_scores(spark, out, "epochs").groupBy("session_id").count().where("count = 59").count() == 2
    other = se.Plan(**{**PLAN.__dict__, "force": "Wake", "threshold": 0.0})
    assert se.publish_scores(spark, one, model, other, out).first().status == "scored"
    assert {(r.session_id, r.n) for r in se.read_scores(spark, out, "bouts").groupBy("session_id").agg(F.count("label").alias("n")).where("session_id = 'a'").collect()} == {("a", 1)}
    assert len(list((tmp_path / "o" / "versions").iterdir())) == 3  # what was scored before is still there
    with pytest.raises(ValueError):
        se.read_scores(spark, str(tmp_path / "none"), "epochs")


def test_features_are_made_once_for_labels_training_and_scoring(session):
    plan = se.session_features(session, PLAN)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("percentile", "Aggregate", "Join", "Window")), plan[:500]
