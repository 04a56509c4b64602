"""Properties of filters, pairs, decoding and geometry on made signals."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracetide.operators import clock as ck
from tracetide.operators import dynamics as dy
from tracetide.operators import events as ev
from tracetide.operators import features as fe
from tracetide.operators import geometry as ge
from tracetide.operators import pairs as pr
from tracetide.operators import scoring as sc
from tracetide.operators import signals as sg
from tracetide.operators import stats as ss
from tracetide.operators import tables as tt


def trace(spark, *series):
    rows = [(u, i, None if v is None or math.isnan(v) else float(v)) for u, s in enumerate(series) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "unit_id long, sample_idx long, value double").withColumn("unit_pos", F.col("unit_id"))


def column(df, col):
    return df.orderBy("sample_idx").toPandas()[col].to_numpy(float)


def test_matched_filter_peaks_at_the_onset(spark):
    h = sg.decay_kernel(0.1, 50)
    assert sum(x * x for x in h) == pytest.approx(1)
    x = np.zeros(200)
    x[60 : 60 + len(h)] += h
    got = column(sg.matched_filter(trace(spark, x), ["unit_id"], h), "filtered")
    assert np.nanargmax(got) == 60 and np.nanmax(got) == pytest.approx(1)
    centred = column(sg.matched_filter(trace(spark, x), ["unit_id"], h, centred=True), "filtered")
    assert np.nanargmax(centred) == 60 + math.ceil((len(h) - 1) / 2)


def test_gaps_stay_missing(spark):
    x = np.random.default_rng(0).normal(10, 1, 120)
    x[30:40] = math.nan
    t = trace(spark, x)
    for df, col in ((sg.exponential_filter(t, ["unit_id"], 0.8), "filtered"), (sg.baseline(t, ["unit_id"]), "f0"), (sg.richardson_lucy(t, ["unit_id"], sg.unit_sum_kernel(1, 1)), "sharp"), (sg.butterworth(t, ["unit_id"], 0.05, 1.0), "passed")):
        assert np.isnan(column(df, col)[30:40]).all() and np.isfinite(column(df, col)[:30]).all()
    assert np.isfinite(column(sg.fill_linear(t, ["unit_id"]), "filled")).all()


def test_exponential_filter_is_the_recursion(spark):
    x = np.random.default_rng(1).normal(0, 1, 30)
    d = np.empty(30)
    d[-1] = 0.7 * x[-1]
    for i in range(28, -1, -1):
        d[i] = 0.7 * d[i + 1] + 0.3 * x[i]
    assert column(sg.exponential_filter(trace(spark, x), ["unit_id"], 0.7), "filtered") == pytest.approx(d)


def test_high_pass_takes_out_a_line_and_a_constant(spark):
    t = np.arange(400)
    got = column(sg.butterworth(trace(spark, 5 + np.sin(t * 2)), ["unit_id"], 0.02, 1.0), "passed")
    assert abs(got[100:300].mean()) < 0.01 and got[100:300].std() == pytest.approx(np.sin(t * 2).std(), rel=0.05)


def test_correlation_ignores_constants_and_gaps(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    b = 0.8 * a + 0.6 * rng.normal(size=300)
    b[:20] = math.nan
    got = {(r.i, r.j): (r.r, r.n) for r in pr.pearson(trace(spark, a, b, np.ones(300))).collect()}
    assert got[0, 1][0] == pytest.approx(np.corrcoef(a[20:], b[20:])[0, 1]) and got[0, 1][1] == 280
    assert got[0, 2][0] is None and got[1, 2][0] is None


def test_aggregators_agree_on_one_bout(spark):
    rng = np.random.default_rng(3)
    t = trace(spark, rng.normal(size=50), rng.normal(size=50)).withColumn("bout_idx", F.lit(0))
    r = pr.pearson(t, ["bout_idx"])
    want = r.first().r
    for got in (pr.simple_mean(r).first().r, pr.fisher_mean(r).first().r, pr.fisher_mean(r, weighted=False).first().r, pr.pooled(t, []).first().r):
        assert got == pytest.approx(want)


def test_lag_is_found(spark):
    x = np.convolve(np.random.default_rng(4).normal(size=700), np.ones(5) / 5, "same")
    got = pr.lagged(trace(spark, x[:600], x[10:610]), [], 15).first()
    assert got.lag == 10 and got.peak_r > 0.9  # a positive lag: the second unit leads


def test_rank_stability_and_subspaces(spark):
    z = spark.createDataFrame([(b, str(p), float(p if b < 2 else -p)) for b in range(3) for p in range(6)], "bout_idx long, pair string, z double")
    got = {r.bout_idx: r.rho for r in dy.rank_stability(z, [1]).collect()}
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(-1)
    eye = np.eye(6)
    rows = [(b, c, u, float(eye[u, c + (3 if b == 2 else 0)])) for b in range(3) for c in range(3) for u in range(6)]
    s = {(r.bout_i, r.bout_j): r.similarity for r in dy.subspace_similarity(spark.createDataFrame(rows, "bout int, component int, unit_pos int, loading double"), 3).collect()}
    assert s[0, 1] == pytest.approx(1) and s[0, 2] == pytest.approx(0)


@pytest.mark.parametrize("smoothness", [0.0, 0.5, 1.0])
def test_viterbi_with_self_transitions_equals_all_segmentations(smoothness):
    model = sc.Durations.smooth(["a", "b", "c"], {"a": 4.0, "b": 2.0, "c": 6.0}, 2.0, smoothness, longest_s=7.0)
    assert np.exp(model.log_transition).sum(1) == pytest.approx(1) and np.exp(model.log_duration).sum(1) == pytest.approx(1) and model.log_duration.shape == (3, 3)
    rng = np.random.default_rng(6)
    for _ in range(6):
        log_p = np.log(rng.dirichlet([1, 1, 1], 6))

        def best(t, before):
            """The best score of what follows epoch t, and its states."""
            if t == 6:
                return 0.0, ()
            found = []
            for s, d in itertools.product(range(3), range(1, min(3, 6 - t) + 1)):
                after, rest = best(t + d, s)
                enter = -math.log(3) if before is None else model.log_transition[before, s]
                found.append((enter + model.log_duration[s, d - 1] + log_p[t : t + d, s].sum() + after, (s,) * d + rest))
            return max(found)

        assert tuple(sc.viterbi(log_p, model)) == best(0, None)[1]


def test_viterbi_equals_brute_force():
    model = sc.Durations.build(["a", "b", "c"], {"a": 4.0, "b": 2.0, "c": 6.0}, {"a": 0.7, "b": 0.9, "c": 0.5}, 2.0, 10.0)
    rng = np.random.default_rng(5)
    for _ in range(5):
        log_p = np.log(rng.dirichlet([1, 1, 1], 6))

        def score(path):
            runs = [(s, len(list(g))) for s, g in itertools.groupby(path)]
            if any(n > model.log_duration.shape[1] for _, n in runs):
                return -math.inf
            return -math.log(3) + sum(model.log_duration[s, n - 1] for s, n in runs) + sum(model.log_transition[a[0], b[0]] for a, b in itertools.pairwise(runs)) + sum(log_p[t, s] for t, s in enumerate(path))

        best = max(itertools.product(range(3), repeat=6), key=score)
        assert score(tuple(sc.viterbi(log_p, model))) == pytest.approx(score(best))


def test_circle(spark):
    a = np.linspace(0, 5, 9)
    rows = [(1, 100 + 7 * math.cos(x), 50 + 7 * math.sin(x), 0.9) for x in a] + [(2, float(k), 2.0 * k, 1.0) for k in range(5)] + [(3, 1.0, 1.0, 1.0)]
    got = {r.frame: r for r in ge.fit_circles(spark.createDataFrame(rows, "frame int, x double, y double, w double"), ["frame"]).collect()}
    assert (got[1].cx, got[1].cy, got[1].diameter) == pytest.approx((100, 50, 14))
    assert got[2].cx is None and got[3].cx is None


def test_nearest_and_as_of(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 3.0)], "k int, t double")
    right = spark.createDataFrame([(1, 0.5, "a"), (1, 5.2, "b")], "k int, t double, v string")
    got = {(r.k, r.t): r.match for r in ck.as_of(left, right, ["k"], "t", "v").collect()}
    assert got == {(1, 1.0): "a", (1, 5.0): "a", (2, 3.0): None}
    near = {(r.k, r.t): r.match for r in ck.nearest(left, right, ["k"], "t", "v", 1.0).collect()}
    assert near == {(1, 1.0): "a", (1, 5.0): "b", (2, 3.0): None}


def test_student_p(spark):
    df = spark.createDataFrame([(2.0, 5.0), (0.0, 3.0), (None, 3.0)], "t double, n double").withColumn("p", ss.student_p("t", "n"))
    assert [r.p for r in df.collect()] == [pytest.approx(0.101939, abs=1e-5), pytest.approx(1), None]


def test_labels(spark):
    df = spark.createDataFrame([(" nrem_sws ",), ("Artifact",), ("x",), (None,)], "label string")
    known, other = sc.standard_labels(df)
    assert sorted(r.label for r in known.collect()) == ["NREM", "Wake"] and other.count() == 2
    assert sc.standard_labels(df, drop_artifact=True)[0].count() == 1


def test_empty_trace(spark):
    t = trace(spark, [1.0]).where("false")
    assert pr.pearson(t).count() == 0 and sg.peaks(t, ["unit_id"]).count() == 0 and sg.fill_linear(t, ["unit_id"]).count() == 0
    assert isinstance(sg.baseline(t, ["unit_id"]).toPandas(), pd.DataFrame)


def test_baseline_follows_a_slow_drift_under_events_and_gaps(spark):
    rng = np.random.default_rng(7)
    t = np.arange(600) / 50
    slow = 100 + 8 * np.sin(t / 3) + 2 * t
    x = slow + sum(a * np.exp(-(((t - c) / 0.15) ** 2)) for a, c in ((40, 2.5), (30, 6.5), (50, 9.0))) + rng.normal(0, 1, 600)
    x[140:155] = x[330:338] = np.nan
    out = sg.relative_change(trace(spark, x), ["unit_id"], 10, 200)
    f0, dff = column(out, "f0"), column(out, "dff")
    quiet = (t < 1.5) | ((t > 4) & (t < 5.5)) | ((t > 10) & (t < 11.5))
    assert (np.isnan(f0) == np.isnan(x)).all() and (np.isnan(dff) == np.isnan(x)).all()
    assert np.nanmedian(np.abs(f0 - slow)[quiet]) < 5 and abs(np.nanmedian(dff[quiet])) < 0.05 and np.nanmax(dff) > 0.12


def test_monotone_cubic_keeps_to_the_data():
    x = np.array([0.0, 1, 3, 4, 7])
    assert sg.monotone_cubic(x, 2 * x + 1, np.linspace(0, 7, 50)) == pytest.approx(2 * np.linspace(0, 7, 50) + 1)
    up = sg.monotone_cubic(x, np.array([0.0, 0, 5, 5, 6]), np.linspace(0, 7, 200))
    assert (np.diff(up) >= -1e-12).all() and up.min() == 0 and up.max() == 6


def test_block_recursions_are_those_of_single_samples():
    u = np.random.default_rng(2).normal(0, 1, 777)
    want, y = [], 0.0
    for v in u:
        y = 0.9 * y + v
        want.append(y)
    assert sg.decayed(u, 0.9) == pytest.approx(np.array(want))
    b, a = sg._biquad(0.05, 1.0, True)
    own, carried, after, kept = sg._blocks(b, a, 32)
    x, z, z1, z2, out = u[:32], np.array([0.3, -0.2]), 0.3, -0.2, []
    for v in x:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    assert own @ x + carried @ z == pytest.approx(np.array(out)) and after @ x + kept @ z == pytest.approx(np.array([z1, z2]))


@pytest.mark.parametrize(("window", "step"), [(40, None), (40, 15)])
def test_noise_in_windows_is_that_of_slices(spark, window, step):
    x = np.random.default_rng(5).normal(0, 1, 130)
    x[50:55] = np.nan
    got = {r.win: r for r in sg.signal_to_noise(trace(spark, x), ["unit_id"], window=window, step=step).collect()}
    starts = list(range(0, 130 - window + 1, step or window))
    assert sorted(got) == list(range(len(starts)))
    for k, s in enumerate(starts):
        own = next(iter(sg.signal_to_noise(trace(spark, x[s : s + window]), ["unit_id"]).collect()))
        assert (got[k].noise, got[k].signal, got[k].centre) == (pytest.approx(own.noise), own.signal, s + (window - 1) / 2)


def test_transitions_of_two_recordings(spark):
    """Recordings don't mix, short bouts don't count, windows start where the bout before does."""
    rng = np.random.default_rng(5)
    one = trace(spark, *rng.normal(0, 1, (3, 200))).withColumn("rec", F.lit(1))
    two = trace(spark, *rng.normal(0, 1, (2, 200))).withColumn("rec", F.lit(2))
    bouts = [(1, "W", 0.0, 30.0), (1, "N", 30.0, 90.0), (1, "W", 90.0, 95.0), (1, "N", 95.0, 190.0), (2, "W", 3.0, 50.0), (2, "N", 50.0, 58.0), (2, "W", 58.0, 88.0), (2, "N", 88.2, 150.0), (2, "N", 30.0, 45.0)]
    b = spark.createDataFrame(bouts, "rec int, state string, start_time double, end_time double")
    found = {(r.rec, r.t0, r.pre_start) for r in dy.onsets(b, "N", "W", keys=["rec"], min_before=20, min_onset=10).collect()}
    assert found == {(1, 30.0, 0.0), (2, 88.2, 58.0)}
    got = dy.transition_synchrony(one.unionByName(two), b, "N", "W", 10, 5, 28, 20, 0.5, keys=["rec"], min_before=20, min_onset=10).orderBy("rec", "phase", "k").toPandas()
    first = got[got["rec"] == 1]
    assert first[first["phase"] == "pre"]["t_rel"].tolist() == [-23.0, -18.0, -13.0, -8.0] and first[first["phase"] == "post"]["t_rel"].tolist() == [5.0, 10.0, 15.0]
    assert (first["n_pairs"] == 3).all() and (got[got["rec"] == 2]["n_pairs"] == 1).all()
    alone = dy.transition_synchrony(two, b.where("rec = 2"), "N", "W", 10, 5, 28, 20, 0.5, min_before=20, min_onset=10).orderBy("phase", "k").toPandas()
    assert alone["mean_r"].tolist() == pytest.approx(got[got["rec"] == 2]["mean_r"].tolist())
    anything = dy.onsets(b, "N", None, keys=["rec"])
    assert anything.count() == 5 and dy.transition_windows(anything, 10, 5, 12, 0).where("phase = 'pre'").groupBy("rec", "t0").count().where("count = 1").count() == 5


def test_signed_ranks(spark):
    rows = [(k, float(v)) for k, v in enumerate([1.5, -0.5, 2.5, 3.5, 4.0, -1.0, 2.0])]
    r = ss.cluster_test(spark.createDataFrame(rows, "c int, delta double"), "c").first()
    assert (r.w_plus, r.w_minus) == (25.0, 3.0)
    below = sum(sum(k + 1 for k in range(7) if m >> k & 1) <= 3 for m in range(128))
    assert r.w_p == pytest.approx(2 * below / 128)


def test_cluster_interval_and_ties_over_many_clusters(spark):
    rng = np.random.default_rng(8)
    y = np.append(np.round(rng.normal(0.3, 1, 500), 1), [0.0, 0.0])
    r = ss.cluster_test(spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "c int, delta double").repartition(4), "c").first()
    own = pd.Series(np.abs(y[y != 0])).rank()
    plus, minus = own[y[y != 0] > 0].sum(), own[y[y != 0] < 0].sum()
    assert (r.w_plus, r.w_minus) == (pytest.approx(plus), pytest.approx(minus)) and r.n == 502
    half = 1.9647 * y.std(ddof=1) / math.sqrt(502)  # of t with 501 degrees of freedom
    assert (r.low, r.high) == (pytest.approx(y.mean() - half, abs=1e-4), pytest.approx(y.mean() + half, abs=1e-4))
    few = ss.cluster_test(spark.createDataFrame([(1, 2.0), (2, 4.0)], "c int, delta double"), "c").first()
    assert few.high - few.low == pytest.approx(2 * 12.7062 * math.sqrt(2) / math.sqrt(2), rel=1e-4)
    assert ss.cluster_test(spark.createDataFrame([(1, 2.0)], "c int, delta double"), "c").first().low is None
    places = [r["__place"] for r in ss.in_order(spark.range(50).repartition(7), F.desc("id")).orderBy("id").collect()]
    assert places == list(range(49, -1, -1))


def test_pairs_stay_in_their_recording(spark):
    rng = np.random.default_rng(3)
    a = trace(spark, *rng.normal(0, 1, (3, 60))).withColumn("rec", F.lit(1))
    b = trace(spark, *rng.normal(0, 1, (3, 60))).select(F.col("unit_id") + 10, "sample_idx", "value", F.col("unit_pos") + 10, F.lit(2)).toDF("unit_id", "sample_idx", "value", "unit_pos", "rec")
    bouts = spark.createDataFrame([(1, 0, "A", 0, 20), (1, 1, "B", 21, 59), (2, 0, "A", 5, 40)], "rec int, bout_idx int, state string, start_time int, end_time int")
    units = spark.createDataFrame([(u, u % 2, 0) for u in (0, 1, 2, 10, 11, 12)], "unit_id long, group_id int, group_type int")
    both = tt.state_pair_table(a.unionByName(b), bouts, units, recording=["rec"])
    apart = [tt.state_pair_table(x, bouts.where(F.col("rec") == k).drop("rec"), units).withColumn("rec", F.lit(k)) for k, x in ((1, a.drop("rec")), (2, b.drop("rec")))]
    rows = lambda d: sorted((r.rec, r.state, r.i, r.j, round(r.z, 9), r.n_samples) for r in d.collect())
    assert rows(both) == rows(apart[0].unionByName(apart[1])) and both.count() == 9


def test_onset_synchrony_and_bins(spark):
    x = np.random.default_rng(4).normal(0, 1, (3, 80))
    bouts = spark.createDataFrame([("W", 0, 30), ("N", 30, 80)], "state string, start_time int, end_time int")
    got = dy.onset_synchrony(trace(spark, *x), bouts, "N", "W", 10, 5, 20, 0.5).orderBy("k").toPandas()
    assert got["t_rel"].tolist() == [-15.0, -10.0, -5.0, 5.0, 10.0, 15.0, 20.0, 25.0] and (got["n_pairs"] == 3).all()
    table = spark.createDataFrame([(1, 0, "a", 0.2), (1, 0, "a", 0.4), (2, 0, "a", 0.9), (1, 0, "b", 9.0)], "cell int, bin int, pair_type string, r double")
    assert [(r.bin, round(r["mean"], 9), r.n_cells) for r in dy.mean_by_bin(table, ["a"], ["bin"], "cell").collect()] == [(0, 0.6, 2)]


def test_feature_table_leaves_out_what_is_thin(spark):
    fs, n = 10.0, 100
    epochs = spark.createDataFrame([(1, k, 5.0 * k, 5.0 * k + 5) for k in range(2)], "session_id int, epoch_idx int, e_start double, e_end double")
    t = np.arange(n) / fs
    samples = spark.createDataFrame([(1, float(v), float(np.sin(20 * v))) for v in np.arange(0, 10, 0.01)], "session_id int, t double, value double")
    rows = [(1, i, float(t[i]), float(i % 7), 1.0 * i, 2.0, 0.2 if i % 2 else 0.8, float((i * i) % 11), i < 50, i < 50, i % 2 == 0, True, i >= 55) for i in range(n)]
    frames = spark.createDataFrame(rows, "session_id int, frame int, t double, diameter double, motion double, eyelid double, eyelid_norm double, whisking double, pupil_ok boolean, motion_ok boolean, eyelid_ok boolean, whisk_ok boolean, camera_off boolean")
    a, b = fe.feature_table(epochs, samples, frames, "session_id", 100.0, fs, 5.0).orderBy("epoch_idx").collect()
    d = np.arange(50) % 7
    v = np.diff(d) / np.diff(t[:50])
    assert (a.diam_mean, a.diam_std, a.speed_mean) == (pytest.approx(d.mean()), pytest.approx(d.std()), pytest.approx(np.abs(v).mean()))
    assert a.constriction_rate == pytest.approx((v < 0).mean()) and a.closed_share == 0 and b.diam_mean is None and b.eyelid_mean == 2.0
    w = (np.arange(50) ** 2 % 11).astype(float)
    up = w > np.median(w) + 3 * (np.median(np.abs(w - np.median(w))) + 1e-9)
    assert (a.whisk_active, a.whisk_bursts) == (pytest.approx(up.mean()), (np.diff(up.astype(int)) == 1).sum())
    assert (a.pupil_share, b.pupil_share, b.off_share, b.camera_off_epoch) == (1.0, 0.0, pytest.approx(0.9), 1.0)
    assert a.log_delta_1s is not None and a.log_ugamma_4s is not None and a.ugamma_delta_1s == pytest.approx(math.log((math.exp(a.log_ugamma_1s) + 1e-9) / (math.exp(a.log_delta_1s) + 1e-9))) and "log_hgamma_1s" in a.asDict()


def test_deconvolution_finds_events_and_favours_busy_units(spark):
    rng = np.random.default_rng(11)
    kernel = np.exp(-np.arange(40) / 5)
    spikes = [np.zeros(400), np.zeros(400)]
    spikes[0][[50, 120, 190, 260, 330]], spikes[1][200] = 4.0, 4.0
    x = [np.convolve(s, kernel)[:400] + rng.normal(0, 0.1, 400) for s in spikes]
    got = ev.deconvolved_events(trace(spark, *x), ["unit_id"], 5.0, 1.0).toPandas()
    assert {0: 5, 1: 1} == {u: len(g[g.peak_value > 10]) for u, g in got.groupby("unit_id")}
    scale = got.groupby("unit_id")["scale"].first()
    assert scale[0] < 1 < scale[1]


def test_pair_sums_equal_a_join(spark):
    """Blocks, tiles, gaps, copies of a sample and values that aren't finite against the pairs of a join."""
    rng = np.random.default_rng(5)
    rows = [(k, u, t, float(rng.integers(9))) for k in (0, 1) for u in range(-3, 9) for t in range(-20, 40) if rng.random() < 0.6]
    rows += [*rows[::7], (0, 2, 100, 5.0), (1, 4, 3, float("nan")), (1, 5, 4, float("inf")), (0, None, 3, 1.0), (None, 1, 3, 1.0), (None, 2, 3, 1.0), (0, 3, 3, None)]
    df = spark.createDataFrame(rows, "k int, unit_pos int, sample_idx int, value double")
    a, b = df.withColumnsRenamed({"unit_pos": "i", "value": "x"}), df.withColumnsRenamed({"unit_pos": "j", "value": "y"})
    both = a.join(b, ["k", "sample_idx"]).where("i < j and x is not null and y is not null")
    want = both.groupBy("k", "i", "j").agg(F.count("x").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.expr("x * x")).alias("sxx"), F.sum(F.expr("y * y")).alias("syy"), F.sum(F.expr("x * y")).alias("sxy"))
    as_rows = lambda d: {tuple(r)[:4]: None if any(not np.isfinite(v) for v in tuple(r)[4:]) else tuple(r)[4:] for r in d.collect()}
    for block, tile in ((4096, 64), (16, 4)):
        got = pr.pair_sums(df, ["k"], block, tile)
        assert as_rows(got) == as_rows(want) and got.schema.simpleString() == want.schema.simpleString()
    assert not any(x in got._jdf.queryExecution().optimizedPlan().toString() for x in ("(i#", "(j#"))  # pairs don't arise as rows of a join


def test_tiles_of_sums_add_up_over_blocks_and_batches(spark):
    """The sums of a tile move as one row and are added as rows come, whatever batches they come in; no table of pairs is built."""
    rng = np.random.default_rng(6)
    rows = [(k, u, t, float(rng.integers(9))) for k in ("a", "b") for u in range(7) for t in range(60) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, unit_pos int, sample_idx int, value double")
    want = {tuple(r) for r in pr.pair_sums(df, ["k"]).collect()}
    assert len({r[:3] for r in want}) == len(want) == 2 * 21
    for batch in (1, 2, 5):
        with_batches = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.shuffle.partitions": "2"}
        before = {c: spark.conf.get(c) for c in with_batches}
        try:
            for c, v in with_batches.items():
                spark.conf.set(c, v)
            got = pr.pair_sums(df, ["k"], 8, 3)
            rows = [tuple(r) for r in got.collect()]
        finally:
            for c, v in before.items():
                spark.conf.set(c, v)
        assert set(rows) == want and len(rows) == len(want)
        assert "sum(sxy" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sessions_decoded_side_by_side_equal_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(sc, "DECODED", 50)
    model = sc.Durations.build(["a", "b", "c"], {"a": 4.0, "b": 2.0, "c": 6.0}, {"a": 0.7, "b": 0.9, "c": 0.5}, 2.0, 10.0)
    rng = np.random.default_rng(8)
    parts = {s: rng.dirichlet([1, 1, 1], n) for s, n in {"s": 1, "t": 7, "u": 4, "v": 120, "w": 30, "x": 31, None: 6}.items()}
    df = spark.createDataFrame([(s, t, *map(float, row)) for s, p in parts.items() for t, row in enumerate(p)], "session_id string, epoch_idx int, P_a double, P_b double, P_c double")
    got = sc.decode_sessions(df.repartition(3), model).toPandas()
    for s, p in parts.items():
        own = got[got.session_id.isna() if s is None else got.session_id == s].sort_values("epoch_idx")
        assert own.state.tolist() == [model.states[k] for k in sc.viterbi(np.log(p), model)]
    log_p = np.log(np.stack([parts["x"][:20], parts["v"][:20]], 1))
    both = sc.viterbi_side_by_side(log_p, np.array([20, 9]), model)
    assert both[:, 0].tolist() == sc.viterbi(log_p[:, 0], model).tolist() and both[:9, 1].tolist() == sc.viterbi(log_p[:9, 1], model).tolist()


def test_strata_take_exact_medians_from_one_order(spark):
    rng = np.random.default_rng(9)
    rows = [(st, ["within_group", "between_same_type", "between_cross_type"][k % 3], f"{k % 2}_1", None if k % 11 == 0 else float(rng.integers(40)) / 8, float(rng.normal())) for k in range(301) for st in ("A", "B", None)]
    df = spark.createDataFrame([*rows, ("C", "within_group", "0_0", None, None)], "state string, pair_type string, same_type string, r double, z double").repartition(5)
    got = pr.stratified(df, ["state"])
    each = F.array_compact(F.array("pair_type", F.when(F.col("pair_type") != "within_group", F.concat(F.lit("type_"), F.col("same_type"))), F.lit("all_pairs")))
    want = df.withColumn("stratum", F.explode(each)).groupBy("state", "stratum").agg(F.avg("r"), F.percentile("r", F.lit(0.5)), F.avg("z"), F.percentile("z", F.lit(0.5)), F.count(F.lit(1)), F.count("r"))
    key = lambda d: {tuple(r)[:2]: tuple(None if v is None else round(v, 9) for v in tuple(r)[2:]) for r in d.collect()}
    assert key(got) == key(want) and len(key(got)) == 3 * 6 + 2
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()  # which holds a stratum's values in one task


def test_bootstrap_draws_the_same_from_lists_as_from_rows(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(t, t * 10 + m, i, i + 1 + j, None if (i, j) == (1, 0) else float(rng.normal())) for t in range(3) for m in range(2 + t) for i in range(3) for j in range(1 + m + t)]
    df = spark.createDataFrame(rows, "t int, m int, i long, j long, delta double").repartition(4)
    found = []
    for most in (0, 6, 4096):
        monkeypatch.setattr(ss, "PACKED", most)
        found.append({r.rep: r.statistic for r in ss.bootstrap(df, ["t", "m"], 20).collect()})
    assert len(found[0]) == 20 and len(set(found[0].values())) > 10
    for other in found[1:]:
        assert other == pytest.approx(found[0], abs=1e-12)
