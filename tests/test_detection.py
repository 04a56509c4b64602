"""Detection on planted events: decay times, drift, F0 that leaks in, gaps, penalties, refresh."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import detection as de

FS, TAU = 200.0, 0.06


def planted(seed, n=24_000, rate=0.004, tau=TAU, noise=0.05, least=1.0):
    rng = np.random.default_rng(seed)
    spikes = np.where(rng.random(n) < rate, least + rng.random(n), 0.0)
    kernel = np.exp(-np.arange(300) / (tau * FS))
    return spikes, np.convolve(spikes, kernel)[:n] + rng.normal(0, noise, n)


def frame(spark, series, extra=None):
    rows = [(u // 2, u, i, None if math.isnan(v) else float(v)) for u, s in enumerate(series) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "rec long, unit_id long, sample_idx long, value double")


def brute_prominence(y, p):
    sides = []
    for step in (-1, 1):
        k, low = p, y[p]
        while 0 <= k < len(y) and y[k] <= y[p]:
            low = min(low, y[k])
            k += step
        sides.append(low)
    return y[p] - max(sides)


def test_prominence_by_one_stack():
    rng = np.random.default_rng(0)
    for n in (3, 10, 200):
        for _ in range(40):
            y = rng.integers(0, 9, n).astype(float)
            at, stands = de.turning_points(y)
            assert stands.tolist() == [brute_prominence(y, p) for p in at]
            starts = [i for i in range(1, n) if y[i] > y[i - 1] and any(y[j] < y[i] for j in range(i, n) if (y[i:j] == y[i]).all())]
            assert at.tolist() == starts
    assert de.turning_points(np.array([1.0]))[0].size == 0
    at, high = np.array([0, 3, 4, 9]), np.array([1.0, 5.0, 5.0, 2.0])
    assert de.apart(at, high, 2).tolist() == [True, True, False, True] and de.apart(at, high, 20).tolist() == [False, True, False, False]


@pytest.mark.parametrize("tau", [0.04, 0.06, 0.11])
def test_decay_time_is_found_within_ten_percent(spark, tau):
    x = [planted(k, tau=tau)[1] + 3 * np.sin(np.arange(24_000) / 9000) for k in range(3)]
    x[1][5000:5400] = np.nan
    s = de.Settings(FS, least_points=5)
    got = de.decay_time(de.decay_tails(frame(spark, x), ["rec", "unit_id"], s), s).collect()
    assert len(got) == 1 and got[0].tau == pytest.approx(tau, rel=0.1) and got[0].n_peaks > 50 and got[0].slope == pytest.approx(-1 / got[0].tau)
    by = {r.rec: r.tau for r in de.decay_time(de.decay_tails(frame(spark, x), ["rec", "unit_id"], s), s, ["rec"]).collect()}
    assert by[0] == pytest.approx(tau, rel=0.1)


def test_default_where_there_is_nothing_to_fit(spark):
    s = de.Settings(FS)
    flat = frame(spark, [np.zeros(400), np.random.default_rng(1).normal(0, 1, 400), np.full(50, np.nan)])
    got = de.detect_events(flat, ["rec", "unit_id"], s, within=["rec"])
    assert {r.rec: r.tau for r in got.decay.collect()} == {0: 0.1, 1: 0.1} and got.units.count() == 3
    assert [r.n_events for r in got.units.where("unit_id = 2").collect()] == [0]
    few = de.decay_time(de.decay_tails(frame(spark, [planted(1, 2000)[1]]), ["unit_id"], s), s).first()
    assert 0 < few.n_peaks < 50 and (few.slope, few.tau) == (None, 0.1)
    with pytest.raises(ValueError):
        de.Settings(0)
    assert de.detect_events(flat.where("false"), ["rec", "unit_id"], s).events.count() == 0


def matches(events, spikes, slack=2):
    at = np.flatnonzero(spikes)
    hit = [any(abs(e - a) <= slack for e in events) for a in at]
    false = [e for e in events if not (np.abs(at - e) <= slack).any()]
    return np.mean(hit), len(false)


def test_drift_gaps_and_f0_add_no_events(spark):
    n = 24_000
    spikes, plain = planted(5, n, rate=0.002, noise=0.04)
    t = np.arange(n) / FS
    f0 = 2 + 0.4 * np.sin(2 * np.pi * 0.02 * t) + 0.5 * np.sin(2 * np.pi * 3 * t)
    gap = plain.copy()
    gap[9000:9300] = np.nan
    cases = [plain, plain + 4 * np.sin(2 * np.pi * 0.004 * t) + t / 20, gap, plain + 8 * f0, plain * f0]
    s = de.Settings(FS, tau=TAU, level=8.0, divide=False, second_pass=False)
    keys = ["rec", "unit_id"]
    f = frame(spark, [f0] * len(cases)).withColumnRenamed("value", "f0")
    base = {u: [r.peak_idx for r in g] for u, g in grouped(de.detect_events(frame(spark, cases[:3]), keys, s).events.collect()).items()}
    leak = grouped(de.detect_events(frame(spark, cases[:4]), keys, s, f).events.collect())
    ratio = grouped(de.detect_events(frame(spark, cases), keys, de.Settings(FS, tau=TAU, level=8.0, second_pass=False), f).events.collect())
    inside = spikes.copy()
    inside[8990:9310] = 0
    for u, truth in ((0, spikes), (1, spikes), (2, inside)):
        found, false = matches(base[u], truth)
        assert found > 0.85 and false <= 2, (u, found, false)
    for rows, truth in ((leak[3], spikes), (ratio[4], spikes)):
        found, false = matches([r.peak_idx for r in rows], truth)
        assert found > 0.85 and false <= 2
    without = grouped(de.detect_events(frame(spark, cases[:4]), keys, s).events.where("unit_id = 3").collect()).get(3, [])
    assert matches([r.peak_idx for r in without], spikes)[0] < 0.5  # F0's changes drown the events, if they aren't taken out
    one = ratio[4][0]
    assert one.amp_f == pytest.approx(one.amp_peak * np.median(f0)) and one.time == one.peak_idx / FS


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.unit_id, []).append(r)
    return out


def test_penalties_follow_rates_within_a_recording(spark):
    x = [planted(k, 8000, rate)[1] for k, rate in enumerate((0.02, 0.0005, 0.004, 0.004))]
    got = de.detect_events(frame(spark, x), ["rec", "unit_id"], de.Settings(FS, tau=TAU, level=8.0), within=["rec"])
    scale = {r.unit_id: r.scale for r in got.units.collect()}
    assert scale[0] < 0.75 and scale[1] == 2.0 and scale[2] == pytest.approx(1, abs=0.15) and scale[3] == pytest.approx(1, abs=0.15)
    for r in got.units.collect():
        assert r.n_events == got.events.where(F.col("unit_id") == r.unit_id).count() and r.rate == pytest.approx(r.n_events / 40)
    fit = de.fitted_traces(frame(spark, x), ["rec", "unit_id"], de.Settings(FS, tau=TAU, level=8.0), got, within=["rec"]).where("unit_id = 0").toPandas()
    assert len(fit) == 8000 and np.corrcoef(fit["clean"], fit["fit"])[0, 1] > 0.95 and (fit["amplitude"] >= 0).all()


def test_solver_stops_and_agrees_with_many_rounds():
    spikes, y = planted(9, 3000)
    s = de.Settings(FS, tau=TAU)
    a, fit = de.deconvolve(y, TAU, 0.2, de.Settings(FS, tau=TAU, rounds=3000, tolerance=0))
    b, near = de.deconvolve(y, TAU, 0.2, s)
    cost = lambda a, fit: 0.5 * ((fit - y) ** 2).sum() + 0.2 * a.sum()
    assert cost(a, fit) <= cost(b, near) * (1 + 1e-9) and cost(b, near) < 1.1 * cost(a, fit)
    grad = np.array([np.exp(-np.arange(3000 - i) / (TAU * FS))[:700] @ (fit - y)[i : i + 700] for i in range(2000)])
    assert (grad > -0.2 - 1e-2).all() and np.abs(grad[a[:2000] > 0.05] + 0.2).max() < 0.02  # the conditions of a minimum


def test_only_what_changed_is_detected_again(spark, tmp_path):
    x = frame(spark, [planted(k, 3000)[1] for k in range(4)])
    v = lambda *rows: spark.createDataFrame(list(rows), "rec long, source_version string")
    s, out = de.Settings(FS, tau=TAU), str(tmp_path / "o")
    run = lambda versions, s: sorted(r.rec for r in de.refresh_detections(spark, x, out, "rec", ["rec", "unit_id"], s, versions).collect())
    assert run(v((0, "a"), (1, "a")), s) == [0, 1]
    first = sorted(map(tuple, spark.read.parquet(f"{out}/events").where("rec = 0").select("unit_id", "peak_idx").collect()))
    assert run(v((0, "a"), (1, "b")), s) == [1] and run(v((0, "a"), (1, "b")), s) == []
    assert sorted(map(tuple, spark.read.parquet(f"{out}/events").where("rec = 0").select("unit_id", "peak_idx").collect())) == first
    assert run(v((1, "b")), de.Settings(FS, tau=TAU, level=3.0)) == [1]
    assert {r.rec: r.source_version for r in spark.read.parquet(f"{out}/units").collect()} == {0: "a", 1: "b"}


def test_slow_inputs_are_read_once(spark):
    """The passes over a unit read stored traces, so F0's plan isn't part of what is left to do."""
    t = spark.createDataFrame([(0, k, float(k % 7)) for k in range(60)], "unit_id int, sample_idx int, value double")
    f0 = t.select("unit_id", "sample_idx", F.lit(2.0).alias("f0"))
    for df in de.detect_events(t, ["unit_id"], de.Settings(fs=1.0, cutoff=0.02), f0):
        assert "f0#" not in (plan := df._jdf.queryExecution().optimizedPlan().toString()) or "LogicalRDD" in plan
        assert "Join LeftOuter, ((unit_id" not in plan or plan.count("FlatMapGroupsInArrow") <= 1
