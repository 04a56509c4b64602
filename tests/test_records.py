"""Rules about whole recordings on worked examples."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracetide.operators import clock as ck
from tracetide.operators import records as rc
from tracetide.operators import scoring as sc
from tracetide.operators import signals as sg


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_mask_policy(spark):
    t = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan"))], "sample_idx long, value double")
    assert rows(rc.with_validity(t, ["sample_idx"]), "sample_idx", "is_valid") == [(0, True), (1, False), (2, False)]
    assert rows(rc.with_validity(t.withColumn("is_valid", F.lit(True)), ["sample_idx"]), "is_valid") == [(True,)] * 3
    mask = spark.createDataFrame([(0, False), (1, True)], "sample_idx long, is_valid boolean")
    assert rows(rc.with_validity(t, ["sample_idx"], mask), "sample_idx", "is_valid") == [(0, False), (1, True), (2, False)]
    with pytest.raises(ValueError):
        rc.with_validity(t.withColumn("value", F.lit(True)), ["sample_idx"])


def test_channels_and_frames_that_do_not_fit_are_errors(spark):
    t = spark.createDataFrame([(0, 1), (1, 1)], "sample_idx int, channel int")
    assert rc.single_channel(t).columns == ["sample_idx"] and rc.single_channel(t).count() == 2 and rc.single_channel(rc.single_channel(t)).count() == 2
    with pytest.raises(PySparkException):
        rc.single_channel(t.union(t.withColumn("channel", F.lit(2)))).collect()
    clock = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.1)], "k int, frame int, t double")
    metric = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0)], "k int, frame int, v double")
    assert rows(rc.frames_match(metric, clock, ["k"]), "t", "v") == [(0.0, 5.0), (0.1, 6.0)]
    with pytest.raises(PySparkException):
        rc.frames_match(metric.limit(1), clock, ["k"]).collect()


def test_grid_classes(spark):
    t = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.1, None), (1, 0.2, 2.0), (1, 0.6, 3.0)], "k int, t double, value double")
    assert rows(rc.grid_classes(t, ["k"], 0.1), "cell", "class") == [(0, "valid"), (1, "missing"), (2, "valid"), (3, "gap"), (4, "gap"), (5, "gap"), (6, "valid")]


def test_states_and_bouts(spark):
    mask = spark.createDataFrame([(i, i != 7) for i in range(20)], "sample_idx long, is_valid boolean")
    st = spark.createDataFrame([("A", 0, 9), ("B", 10, 14), ("A", 15, 19)], "state string, start_time long, end_time long")
    assert rows(rc.state_seconds(mask, st, [], ["A", "C"]), "state", "seconds") == [("A", 14.0), ("C", 0.0)]
    assert rows(rc.segments_in_state(mask, st, "A", 3), "start_time", "end_time", "bout_idx") == [(0, 6, 0), (15, 19, 2)]
    tiles = rows(rc.valid_epochs(mask, st, "A", 4), "start_time", "end_time", "bout_idx")
    assert tiles == [(0, 3, 0), (15, 18, 2), (4, 8, 0)]
    assert rc.valid_epochs(mask, st, "A", 4, draw=2, seed=1).count() == 2


def test_timing_and_blocks(spark):
    s = spark.createDataFrame([(1, 0, 0.0), (1, 0, 1.0), (1, 1, 2.0)], "k int, block_id int, t double")
    off = spark.createDataFrame([(1, 10.0)], "k int, offset double")
    assert rows(rc.timing(s, ["k"], off), "start", "end", "active", "several_blocks") == [(10.0, 13.0, 3.0, True)]
    a, b = (spark.createDataFrame([(x, 0.0) for x in ts], "t double, value double") for ts in ((5.0, 6.0), (0.0, 1.0, 2.0)))
    assert rows(rc.joined_blocks([a, b], 1.0), "block", "t") == [(0, 0.0), (0, 1.0), (1, 2.0), (1, 3.0), (1, 4.0)]
    at = dt.datetime(2024, 1, 1)
    good = spark.createDataFrame([("e", at, 100.0), ("e", at + dt.timedelta(hours=5), 7.0)], "e string, started timestamp, offset double")
    broken = spark.createDataFrame([("e", at + dt.timedelta(seconds=30)), ("f", at)], "e string, started timestamp")
    assert rows(rc.carried_offset(broken, good, ["e"]), "e", "offset") == [("e", 130.0), ("f", None)]
    acq = spark.createDataFrame([("s", "a2", 1), ("s", "a1", 0), ("s", "a3", 2)], "s string, acq string, position int")
    blocks = spark.createDataFrame([("s", "a1", 1), ("s", "a2", 1)], "s string, acq string, block_id int")
    listed, lacking = rc.block_list(acq, blocks, blocks.where("false").select("s", "block_id"), ["s"])
    assert rows(listed, "block_id", "acqs", "status") == [(1, "a1,a2", "ok"), (None, "a3", "unresolved")] and rows(lacking, "block_id") == [(1,)]
    own = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 9.0)], "r int, t double")
    cover = spark.createDataFrame([(7, 0.0, 1.0), (3, 0.4, 2.0)], "block_id int, start_time double, end_time double")
    assert rows(ck.assign_blocks(own, cover, "t", 1.0), "r", "block_id") == [(1, 7), (1, 7), (2, None)]


def test_listings(spark):
    acq = spark.createDataFrame([("a",), ("b",)], "acq string")
    files = spark.createDataFrame([("a", "v1.mat"), ("a", "v2.mat"), ("b", "x.txt")], "acq string, file string")
    assert rows(rc.done_versions(acq, files, ["acq"]), "acq", "done") == [("a", "v2"), ("b", "NO")]
    found = spark.createDataFrame([("x/y/1", 5), ("x/y/2", 6), ("x/z/3", 7)], "path string, size long")
    assert rows(rc.listing_report(found, found.where("path = 'x/z/3'"), 2), "prefix", "n_files", "bytes") == [("x/y", 2, 11)]
    kind = "k int, component string, version string, shape string, ids array<int>"
    e = spark.createDataFrame([(1, "m", "1", "2x2", [1, 2]), (1, "n", "1", "s", [1]), (1, "o", "1", "s", [1]), (1, "p", "1", "s", [1])], kind)
    f = spark.createDataFrame([(1, "m", "1", "2x2", [2, 3]), (1, "n", "2", "s", [1]), (1, "p", "1", "t", [1]), (1, "q", "1", "s", [1])], kind)
    assert rows(rc.audit_components(e, f, ["k"]), "component", "status") == [("m", "other ids"), ("n", "outdated"), ("o", "absent"), ("p", "other shape"), ("q", "unexpected")]
    docs = spark.createDataFrame([('{"s1": {"e1": {"v": 3}}}',), ("broken",)], "document string")
    assert rows(rc.exploded_metadata(docs, "struct<v:int>", ["subject", "exp"]).select("subject", "exp", "entry.v"), "subject", "exp", "v") == [("s1", "e1", 3)]
    pts = spark.createDataFrame([("a", '{"x": 1, "y": 2}'), ("b", "[3, 4.5]"), ("c", "?")], "name string, entry string")
    assert rows(rc.named_points(pts), "name", "x", "y") == [("a", 1.0, 2.0), ("b", 3.0, 4.5), ("c", None, None)]
    assert rows(rc.lookup(acq, F.col("acq") > "a", "acq"), "acq") == [("b",)]


def test_views(spark):
    trace = spark.createDataFrame([(1, i, None if i == 10 else float(i)) for i in range(25)], "unit_id int, sample_idx int, value double")
    noise = spark.createDataFrame([(1, 2.0)], "unit_id int, noise double")
    assert rows(rc.movie_snr(trace, noise, ["unit_id"]), "sample_idx", "snr", "low") == [(0, 0.0, 0.0), (10, 0.0, 0.0), (20, 2.0, 0.0)]
    units = spark.createDataFrame([(0, "g", 2.0), (1, "g", 4.0), (2, "h", 1.0)], "unit_id int, group_id string, pos double")
    px = spark.createDataFrame([(2, 5), (3, 6), (9, 7)], "source_id int, x int")
    assert rows(rc.unit_pixels(px, units), "x", "place") == [(5, 1.0), (6, 0.0)]
    ext = rc.block_extents(units.withColumn("k", F.lit(0)), [F.col("group_id"), F.col("pos").asc_nulls_last()], ["group_id"], ["k"])
    assert rows(ext, "block", "first_row", "last_row") == [("g", 0, 1), ("h", 2, 2)]
    grey = spark.createDataFrame([(f, float(g)) for f in range(4) for g in range(101)], "frame int, grey double")
    assert rows(rc.contrast(grey, []), "low", "high") == [(1.0, 99.0)]
    parts = spark.createDataFrame([(0, "a", 0.5), (0, "b", 1.0), (0, "c", 0.1)], "frame int, part string, likelihood double")
    fits = spark.createDataFrame([(0, 3.0)], "frame int, diameter double")
    assert rows(rc.eye_table(fits, fits.select("frame", F.lit(1.0).alias("open")), parts, {"pupil": ["a", "b"]}, ["frame"]), "diameter", "open", "pupil_likelihood") == [(3.0, 1.0, 0.75)]
    assert rows(rc.unlikely_to_null(parts, ["part"], "likelihood"), "part") == [("a",), ("b",), (None,)]


def test_models_are_kept_and_calibrated_either_way(spark, tmp_path):
    data = [(i, float(i % 3) + (i % 7) / 20, float(i % 5), ["a", "b", "c"][i % 3]) for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, f0 double, f1 double, label string")
    for isotonic in (False, True):
        model = sc.train_states(df, ["f0", "f1"], ["a", "b", "c"], isotonic=isotonic)
        sc.save_model(spark, model, str(tmp_path / str(isotonic)))
        got = sc.argmax_label(sc.state_probabilities(df, sc.load_model(spark, str(tmp_path / str(isotonic)))), model.states)
        want = sc.argmax_label(sc.state_probabilities(df, model), model.states)
        assert rows(got, "row_id", "P_a", "pred_label") == rows(want, "row_id", "P_a", "pred_label") and got.where("label = pred_label").count() > 280
    assert [r.feature for r in sc.importance(spark, model).collect()] == ["f0", "f1"]
    p = spark.createDataFrame([(1, k, a, 1 - a) for k, a in enumerate([0.9, 0.1, 0.9])], "session_id int, epoch_idx int, P_a double, P_b double")
    assert rows(sc.smoothed_label(p, "session_id", ["a", "b"], 3), "epoch_idx", "pred_label") == [(0, "a"), (1, "a"), (2, "a")]
    x = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, -1.0, 0.0, 2.0, -3.0])], "k int, sample_idx int, value double")
    assert rows(sc.zero_crossings(x, ["k"]), "crossings") == [(3,)]


def test_no_window_shrinks_row_by_row(spark):
    """A frame from a row to the end is read anew for each of its rows, which is quadratic in a key's rows."""
    left = spark.createDataFrame([(1, float(t), t) for t in (0, 4, 5, 9, 12)], "k int, t double, x int")
    right = spark.createDataFrame([(1, float(t), t) for t in (2, 6, 10)], "k int, t double, v int")
    near = ck.nearest(left, right, ["k"], "t", "v")
    assert [(r.x, r.match) for r in near.orderBy("x").collect()] == [(0, 2), (4, 2), (5, 6), (9, 10), (12, 10)]
    gaps = spark.createDataFrame([(1, t, v) for t, v in enumerate([None, 1.0, None, None, 4.0, None])], "u int, sample_idx int, value double")
    filled = sg.fill_linear(gaps, ["u"])
    assert [r.filled for r in filled.orderBy("sample_idx").collect()] == [1, 1, 2, 3, 4, 4]
    for df in (near, filled):
        assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().analyzed().toString().lower()
