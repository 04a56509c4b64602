"""Points against lines: the grid finds what a comparison with every segment finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import geometry as ge


def nearest(p, v):
    """(arc, off) by all segments, the first of equal ones."""
    a, b = v[:-1], v[1:]
    d = b - a
    n = (d**2).sum(1)
    t = np.clip(np.divide(((p - a) * d).sum(1), n, out=np.zeros(len(n)), where=n > 0), 0, 1)
    d2 = np.round(((p - a - t[:, None] * d) ** 2).sum(1), 9)
    k = int(d2.argmin())
    size = np.sqrt(n)
    return size[:k].sum() + t[k] * size[k], np.sqrt(d2[k])


def test_arc_length_by_grids(spark):
    rng = np.random.default_rng(7)
    lines = {
        "walk": np.cumsum(rng.normal(0, 1, (300, 2)), 0),
        "long and short": np.array([[0, 0], [1000, 0], [1000, 1], [1000.5, 1], [1000.5, 1], [0, 3]], float),
        "tiny": rng.normal(0, 1e-4, (20, 2)),
        "still": np.full((3, 2), 5.0),
        "zigzag": np.column_stack([np.arange(60) % 7 * 11.0, np.arange(60.0)]),
    }
    points = {k: np.vstack([v[rng.integers(len(v), size=40)] + rng.normal(0, s, (40, 2)) for s in (0.01, 1, 60)] + [v[:3], [[9e4, -9e4]]]) for k, v in lines.items()}
    v = spark.createDataFrame([(k, i, float(x), float(y)) for k, a in lines.items() for i, (x, y) in enumerate(a)] + [("one vertex", 0, 1.0, 1.0)], "line string, pos int, x double, y double")
    p = spark.createDataFrame([(k, i, float(x), float(y)) for k, a in points.items() for i, (x, y) in enumerate(a)] + [("one vertex", 0, 1.0, 1.0), ("no line", 0, 1.0, 1.0)], "line string, point int, x double, y double")
    got = {(r.line, r.point): (r.arc, r.off) for r in ge.arc_length(p, v, "line", "point").collect()}
    assert len(got) == sum(map(len, points.values()))
    for (k, i), (arc, off) in got.items():
        want = nearest(points[k][i], lines[k])
        assert off == pytest.approx(want[1], abs=1e-6) and arc == pytest.approx(want[0], abs=1e-6 if k != "tiny" else 1), (k, i)


def test_points_meet_near_segments_only(spark):
    n = 4000
    v = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(n)], "line int, pos int, x double, y double")
    p = spark.createDataFrame([(0, i, i + 0.25, 0.5) for i in range(0, n - 1, 2)], "line int, point int, x double, y double")
    out = ge.arc_length(p, v, "line", "point")
    assert [(r.arc, r.off) for r in out.where("point = 1000").collect()] == [(1000.25, 0.5)]
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" in joined and out.count() == n // 2


def test_long_segments_everywhere_do_not_multiply(spark):
    """Segments as long as the whole area: what is shuffled is rows of points and segments and not their meetings."""
    rng = np.random.default_rng(3)
    line, at = rng.uniform(0, 100, (500, 2)), rng.uniform(0, 100, (700, 2))
    k, _, d2 = ge._nearest(at, line[:-1], np.diff(line, axis=0))
    want = [nearest(p, line) for p in at]
    assert np.allclose(np.sqrt(d2), [o for _, o in want]) and len(set(k.tolist())) > 100
    v = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(line)], "line int, pos int, x double, y double")
    p = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(at)], "line int, point int, x double, y double")
    out = ge.arc_length(p, v, "line", "point")
    assert np.allclose([r.arc for r in out.orderBy("point").collect()], [a for a, _ in want])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("Generate") == 0  # no row of a point or a segment is repeated over cells


def test_evenly_spaced_where_ranges_are_sampled(spark):
    """So many rows that the cuts of ranges come from samples, which differ from one reading to the next."""
    n = 400_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") * 3).alias("more")).repartition(6)
    for _ in range(2):
        assert sorted(r.k for r in ge.evenly_spaced(rows, "k", 100).collect()) == [int((k + 0.5) * n / 100) for k in range(100)]
