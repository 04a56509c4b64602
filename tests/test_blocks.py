"""Blocks of long units: borders change nothing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_signals import column, trace

from tracetide.operators import blocks as bl
from tracetide.operators import pairs as pr
from tracetide.operators import signals as sg


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(0, 1, 130)) + rng.normal(0, 2, 130)
    x[20:29] = x[64] = x[128:] = np.nan
    return x


@pytest.fixture(scope="module")
def rows(spark, series):
    """A unit with gaps, one without any value, one of a single row, and one that lacks rows."""
    df = trace(spark, series, np.full(9, np.nan), [3.0], series[::-1])
    return df.where("not (unit_id = 3 and sample_idx % 7 = 3)").withColumn("sample_idx", F.col("sample_idx") - 40)


def test_rows_are_numbered_without_a_group(spark, rows):
    got = bl.numbered(rows, ["unit_id"], 16).toPandas().sort_values(["unit_id", "sample_idx"])
    for _, g in got.groupby("unit_id"):
        assert g["__rn"].tolist() == list(range(len(g))) and (g["__rows"] == len(g)).all()


@pytest.mark.parametrize(("block", "window"), [(5, 7), (16, 20), (64, 2)])
def test_windows_at_borders(rows, block, window):
    a = sg.rolling_mad(rows, ["unit_id"], window, block=block).orderBy("unit_id", "sample_idx").toPandas()
    b = sg.rolling_mad(rows, ["unit_id"], window).orderBy("unit_id", "sample_idx").toPandas()
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("block", [16, 50])
def test_recursions_at_borders(rows, block):
    for run in (lambda b: sg.exponential_filter(rows, ["unit_id"], 0.7, block=b), lambda b: sg.butterworth(rows, ["unit_id"], 0.08, 1.0, True, b), lambda b: sg.butterworth(rows, ["unit_id"], 0.2, 1.0, False, b)):
        a, b = (run(k).orderBy("unit_id", "sample_idx").toPandas() for k in (block, bl.SIZE))
        pd.testing.assert_frame_equal(a, b)


def test_recursions_equal_arrays(spark, rows, series):
    own = rows.where("unit_id = 0")
    ok = np.isfinite(series)
    filled = np.interp(np.arange(130), np.flatnonzero(ok), series[ok])
    want = np.where(ok, sg.zero_phase(0.08, 1.0)(filled), np.nan)
    assert column(sg.butterworth(own, ["unit_id"], 0.08, 1.0, block=16), "passed") == pytest.approx(want, nan_ok=True)
    b, a = sg._biquad(0.08, 1.0, True)
    for n in (1, 255, 256, 257, 700):
        x, z = np.random.default_rng(n).normal(0, 1, n), np.array([0.3, -0.2])
        y, end = sg._second_order(b, a).respond(x, z)
        for k in range(n):
            out = b[0] * x[k] + z[0]
            z = np.array([b[1] * x[k] - a[1] * out + z[1], b[2] * x[k] - a[2] * out])
            assert y[k] == pytest.approx(out)
        assert end == pytest.approx(z)
    d, want = 0.0, []
    for k, v in enumerate(series[::-1]):
        d = d * 0.7 + (0 if np.isnan(v) else v * (0.7 if not want or all(np.isnan(want)) else 0.3))
        want.append(np.nan if np.isnan(v) else d)
    assert column(sg.exponential_filter(own, ["unit_id"], 0.7, block=16), "filtered") == pytest.approx(np.array(want)[::-1], nan_ok=True)


@pytest.mark.parametrize(("block", "tile"), [(7, 2), (40, 1), (4096, 64)])
def test_lags_equal_sums_by_definition(spark, block, tile):
    rng = np.random.default_rng(8)
    base = rng.normal(size=90)
    x = [np.roll(base, k) + 0.3 * rng.normal(size=90) for k in (0, 3, -2, 1)] + [np.full(90, 2.0)]
    x[1][10:30] = x[2][80:] = np.nan
    got = {(r.i, r.j): (r.lag, r.peak_r) for r in pr.lagged(trace(spark, *x), [], 6, block, tile).collect()}
    v = [a - np.nanmean(a) for a in x]
    want = {}
    for i in range(4):
        for j in range(i + 1, 4):
            n0 = (np.isfinite(v[i]) & np.isfinite(v[j])).sum()
            at = [(k, np.nansum([v[i][t + k] * v[j][t] for t in range(90) if 0 <= t + k < 90]) / (n0 * np.nanstd(x[i]) * np.nanstd(x[j]))) for k in range(-6, 7)]
            want[i, j] = max(at, key=lambda p: (round(abs(p[1]), 9), -p[0]))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_what_lags_shuffle_does_not_grow_with_them(spark):
    df = trace(spark, *np.random.default_rng(1).normal(size=(3, 300)))
    plan = lambda most: pr.lagged(df, [], most)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(2).count("Generate explode") == plan(100).count("Generate explode") and "sequence(-100, 100" not in plan(100)
