"""Worked examples of masks, tilings and bouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import intervals as iv

FS = 10


def grid(spark, end, gaps):
    t = spark.range(0, end * FS).select(F.col("id").alias("sample_idx"))
    bad = F.lit(False)
    for a, b in gaps:
        bad |= (F.col("sample_idx") >= a * FS) & (F.col("sample_idx") < b * FS)
    return t.withColumn("is_valid", ~bad)


def states(spark, rows):
    return spark.createDataFrame([(s, float(a * FS), float(b * FS)) for s, a, b in rows], "state string, start_time double, end_time double")


CASES = [
    ([("NREM", 0, 24)], [(10, 12)], None, [(0, 10), (12, 22)], [(0, 10), (12, 22)]),
    ([("NREM", 0, 13)], [(6, 8)], None, [(0, 12)], []),
    ([("NREM", 0, 30)], [(8, 12)], None, [(0, 14), (14, 24)], [(12, 22)]),
    ([("NREM", 0, 30)], [(0, 3)], None, [(3, 13), (13, 23)], None),
    ([("NREM", 0, 30)], [(0, 30)], None, [], None),
    ([("NREM", 0, 15), ("Wake", 15, 20), ("NREM", 20, 31)], [], None, [(0, 10), (20, 30)], None),
    ([("NREM", 0, 11)], [(5.5, 5.6)], 10, [(0, 10.1)], None),
    ([("NREM", 0, 50)], [(8, 38)], 10, [(38, 48)], None),
    ([("NREM", 0, 51)], [(8, 38)], None, [(0, 40), (40, 50)], None),
]


@pytest.mark.parametrize("rows,gaps,max_gap,span,strict", CASES)
def test_tiles(spark, rows, gaps, max_gap, span, strict):
    m, s = grid(spark, 60, gaps), states(spark, rows)
    found = [(r.start_time / FS, (r.end_time + 1) / FS) for r in iv.tile_span(m, s, "NREM", 10 * FS, max_gap).orderBy("start_time").collect()]
    # a sample on the edge between two intervals belongs to neither, so starts can lie one sample later
    assert len(found) == len(span) and all(abs(a - x) <= 0.15 and abs(b - y) <= 0.15 for (a, b), (x, y) in zip(found, span, strict=True))
    if strict is not None:
        got = [(r.start_time / FS, (r.end_time + 1) / FS) for r in iv.tile_strict(m, s, "NREM", 10 * FS).orderBy("start_time").collect()]
        assert len(got) == len(strict) and all(abs(a - x) <= 0.15 and abs(b - y) <= 0.15 for (a, b), (x, y) in zip(got, strict, strict=True))


def test_valid_seconds_of_bouts(spark):
    m = grid(spark, 30, [(0, 5), (22, 23)])
    b = iv.state_bouts(m, states(spark, [("NREM", 0, 10), ("Wake", 10, 20), ("REM", 20, 30), ("X", 90, 95)]), dt=0.1).orderBy("start_time").collect()
    assert [round(r.valid_duration) for r in b] == [5, 10, 9, 0]


def test_bout_context(spark):
    b = spark.createDataFrame([("Wake", 0.0, 5.0), ("NREM", 5.0, 15.0), ("Wake", 15.0, 25.0), ("NREM", 25.0, 30.0)], "state string, start_time double, end_time double").withColumn("d", F.col("end_time") - F.col("start_time"))
    got = {(r.state, r.state_idx): (r.clock_start, r.gap) for r in iv.bout_context(b, duration="d").collect()}
    assert got == {("Wake", 0): (0, None), ("Wake", 1): (5, 10), ("NREM", 0): (0, None), ("NREM", 1): (10, 10)}


def test_clock_bins_add_up(spark):
    b = spark.createDataFrame([("N", 0.0, 30.0, 30.0), ("N", 100.0, 150.0, 50.0)], "state string, start_time double, end_time double, wall_duration double")
    rows = iv.state_clock_bins(b, 25.0).collect()
    assert sum(r.slice_end - r.slice_start for r in rows) == pytest.approx(80)
    assert sorted({r.bin for r in rows}) == [0, 1, 2, 3]


@pytest.mark.parametrize("rows,most,out", [
    ([("N", 0, 80), ("W", 80, 82), ("N", 82, 162)], 5, [("N", 0, 162)]),
    ([("N", 0, 80), ("W", 80, 120), ("N", 120, 162)], 5, [("N", 0, 80), ("W", 80, 120), ("N", 120, 162)]),
    ([("N", 0, 80), ("W", 80, 82), ("R", 82, 162)], 5, [("N", 0, 80), ("W", 80, 82), ("R", 82, 162)]),
    ([("N", 0, 80), ("W", 80, 82), ("N", 82, 120), ("W", 120, 122), ("N", 122, 166)], 5, [("N", 0, 166)]),
    ([("N", 0, 80), ("W", 80, 82), ("N", 82, 162)], 0, [("N", 0, 80), ("W", 80, 82), ("N", 82, 162)]),
])
def test_absorb_brief(spark, rows, most, out):
    df = spark.createDataFrame([(1, s, float(a), float(b)) for s, a, b in rows], "k int, state string, start_time double, end_time double")
    got = [(r.state, r.start_time, r.end_time) for r in iv.absorb_brief(df, ["k"], most).orderBy("start_time").collect()]
    assert got == [(s, float(a), float(b)) for s, a, b in out]


def test_empty_mask(spark):
    m = grid(spark, 5, []).where("false")
    assert iv.valid_intervals(m, []).count() == 0
    assert iv.tile_span(m, states(spark, [("NREM", 0, 5)]), "NREM", 3).count() == 0


def test_sweeps_keep_recordings_apart(spark):
    """Two recordings in one plan give what each gives alone, and what pairs of intervals give."""
    rng = np.random.default_rng(6)
    sides = []
    for _ in range(2):
        rows = []
        for rec in (1, 2):
            at = np.cumsum(rng.integers(1, 9, 40))
            rows += [(rec, "ABC"[rng.integers(3)], float(a), float(b)) for a, b in zip(at, at[1:], strict=False) if rng.random() < 0.7]
        sides.append(rows)
    a, b = (spark.createDataFrame(r, "rec int, state string, start_time double, end_time double") for r in sides)
    want = set()
    for rec in (1, 2):
        cuts = sorted({t for side in sides for r, _, *ends in side if r == rec for t in ends})
        for t, t2 in zip(cuts, cuts[1:], strict=False):
            hit = [[x for x in side if x[0] == rec and x[2] <= (t + t2) / 2 < x[3]] for side in sides]
            want |= {(rec, t, t2, x[1], y[1], y[2], y[3]) for x in hit[0] for y in hit[1]}
    seg = iv.atomic_segments(a, b, ["rec"])
    assert {(r.rec, r.t, r.t2, r.a_state, r.b_state, r.b_start, r.b_end) for r in seg.collect()} == want
    got = {(r.rec, r.p_start): (r.dominant, r.total, r.purity) for r in iv.bout_purity(seg, ["rec"]).collect()}
    for (rec, start), (label, total, share) in got.items():
        by = {}
        for r, t, t2, x, _, s, _ in want:
            if (r, s) == (rec, start):
                by[x] = by.get(x, 0) + t2 - t
        best = min(by, key=lambda k: (-by[k], k))
        assert (label, total, share) == (best, sum(by.values()), pytest.approx(by[best] / total))
    assert iv.atomic_segments(a, b.where("false"), ["rec"]).count() == 0


def absorbed_leftmost(rows, most):
    """The rule as it is told: the leftmost brief interval between two of one state goes, again and again."""
    rows = list(rows)
    while True:
        k = next((k for k in range(1, len(rows) - 1) if rows[k][2] - rows[k][1] < most and rows[k - 1][0] == rows[k + 1][0]), None)
        if k is None:
            return rows
        rows[k - 1 : k + 2] = [(rows[k - 1][0], rows[k - 1][1], rows[k + 1][2])]


def test_absorb_brief_is_linear_and_the_rule(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        at = np.cumsum(rng.integers(1, 12, 40)).astype(float)
        states = ["ABC"[x] for x in rng.integers(0, 3, 40)]
        rows += [(k, s, float(a), float(b)) for s, (a, b) in zip(states, zip(at, at[1:], strict=False), strict=False)]
    n = 100_000
    rows += [(99, "AB"[i % 2], float(i * 5), float(i * 5 + 5)) for i in range(n)]
    got = {}
    for r in iv.absorb_brief(spark.createDataFrame(rows, "k int, state string, start_time double, end_time double").repartition(4), ["k"], 6.0).collect():
        got.setdefault(r.k, []).append((r.state, r.start_time, r.end_time))
    for k in range(30):
        own = [r[1:] for r in rows if r[0] == k]
        assert sorted(got[k], key=lambda r: r[1]) == absorbed_leftmost(own, 6.0), k
    assert sorted(got[99], key=lambda r: r[1]) == [("A", 0.0, (n - 1) * 5.0), ("B", (n - 1) * 5.0, n * 5.0)]
