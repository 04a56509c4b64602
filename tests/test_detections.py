"""Event outputs: detected once, kept apart by mode, read with labels and offsets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import clock as ck
from tracetide.operators import intervals as iv
from tracetide.operators import scoring as sc
from tracetide.operators import signals as sg
from tracetide.operators.events import run_events
from tracetide.sources import detections as ds
from tracetide.sources import tables as tb

FS = 200.0


@pytest.fixture(scope="module")
def trace(spark):
    rng = np.random.default_rng(3)
    kernel = np.exp(-np.arange(40) / (ds.TAU * FS))
    rows = []
    for unit in range(3):
        spikes = np.zeros(2400)
        spikes[[300 + 100 * unit, 900, 1500]] = 8.0
        x = np.convolve(spikes, kernel)[:2400] + rng.normal(0, 0.5, 2400)
        rows += [(unit // 2, unit, i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec long, unit_id long, sample_idx long, value double").cache()


KEYS = ["rec", "unit_id"]


def test_pipeline_is_filter_noise_and_runs(trace):
    got = ds.noise_events(ds.signal_and_noise(trace, KEYS, FS, noise_window=2.0), KEYS, FS)
    filtered = sg.matched_filter(trace, KEYS, sg.decay_kernel(ds.TAU, FS)).select(*KEYS, "sample_idx", F.col("filtered").alias("value"))
    noisy = sg.rolling_mad_noise(filtered, KEYS, 2.0, FS).withColumn("snr", F.col("value") / F.greatest(F.col("mad") * 4, F.lit(1e-12)))
    cols = [*KEYS, "start_sample", "end_sample", "peak_sample", "n_samples"]
    assert got.select(cols).exceptAll(run_events(noisy, KEYS, 1.0, FS).select(cols)).count() == 0
    peaks = {(r.unit_id, r.peak_sample) for r in got.where("peak_snr > 1.5").collect()}
    assert all(any(u == v and abs(p - q) <= 2 for v, q in peaks) for u in range(3) for p in (300 + 100 * u, 900, 1500))
    with pytest.raises(ValueError):
        ds.signal_and_noise(trace, KEYS, FS, mode="other")


def test_outputs_and_readers(spark, trace, tmp_path):
    out = str(tmp_path / "o")
    versions = lambda *rows: spark.createDataFrame(list(rows), "rec long, source_version string")
    run = lambda v, **more: sorted(r.rec for r in ds.refresh_events(spark, trace, out, "rec", KEYS, v, FS, noise_window=2.0, **more).collect())
    assert run(versions((0, "a"), (1, "a"))) == [0, 1] and run(versions((0, "a"), (1, "a"))) == []
    assert run(versions((0, "a"), (1, "b"))) == [1] and run(versions((0, "a")), factor=5.0) == [0]
    assert run(versions((0, "a")), mode="denoised") == [0] and not (tmp_path / "o" / "denoised" / "filtered").exists()
    labels = spark.createDataFrame([(0, "d1", 5), (1, "d2", 6)], "unit_id long, group_id string, rec int")
    offsets = spark.createDataFrame([(0, 10.0), (1, -2.0)], "rec long, offset double")
    plain, shifted = (ds.read_events(spark, out, "rec", labels=labels, offsets=o).orderBy("unit_id", "start_sample").collect() for o in (None, offsets))
    assert [r.time for r in plain] == [r.start_sample / FS for r in plain] and len(plain) > 6
    assert all(b.time - a.time == pytest.approx(10 if a.rec == 0 else -2) and b.peak_time - a.peak_time == pytest.approx(b.time - a.time) for a, b in zip(plain, shifted, strict=True))
    assert {(r.unit_id, r.group_id) for r in plain} == {(0, "d1"), (1, "d2"), (2, None)}
    noise = ds.read_samples(spark, out, "rec", FS, "noise", recordings=[0], units=[1], labels=labels, offsets=offsets)
    assert noise.count() == 2400 and noise.agg(F.min("time")).first()[0] == 10.0 and noise.select("group_id").distinct().collect()[0][0] == "d2"
    assert ds.read_samples(spark, out, "rec", FS).select("unit_id").distinct().count() == 3
    with pytest.raises(Exception, match="no offset for"):
        ds.read_events(spark, out, "rec", offsets=offsets.where("rec = 0")).collect()


def test_subjects_that_alone_have_a_state(spark):
    rows = [(i, f"s{i % 3}", "c" if i % 3 == 2 and i % 2 else "ab"[i % 2], float(i % 2), float(i % 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, who string, label string, f0 double, f1 double")
    assert [tuple(r) for r in sc.untrainable(df, "who").collect()] == [("s2", "c")]
    got = sc.leave_one_out(df.where("label <> 'c'"), ["f0", "f1"], ["a", "b"], "who")
    assert got.count() == df.where("label <> 'c'").count() and got.where("label = pred_label").count() > 70


def test_frame_clocks_are_stored_once(spark, tmp_path):
    edges = lambda at: np.isin(np.arange(600) % 1000, np.concatenate([np.arange(a, a + 20) for a in at])).astype(float) * 5
    rows = [(b, i, float(v)) for b, at in ((1, [50, 100, 150, 200, 250]), (2, [30, 90, 150, 210])) for i, v in enumerate(edges(at))]
    signal = spark.createDataFrame(rows, "block int, sample_idx long, value double")
    frames = spark.createDataFrame([(1, 3), (2, 5)], "block int, n_frames int")
    versions = spark.createDataFrame([(1, "a"), (2, "a")], "block int, source_version string")
    out = str(tmp_path / "clock")
    run = lambda: sorted(r.block for r in ds.refresh_frame_clock(spark, signal, frames, out, "block", versions, 100.0).collect())
    assert run() == [1, 2] and run() == []
    got = {(r.block, r.frame): r.time for r in spark.read.parquet(f"{out}/frame_clock").collect()}
    assert {k: got[k] for k in got if k[0] == 1} == {(1, 0): 1.01, (1, 1): 1.51, (1, 2): 2.01}
    assert len([k for k in got if k[0] == 2]) == 5 and got[2, 3] == pytest.approx(2.71) and got[2, 4] == pytest.approx(3.31)


def test_labels_are_checked_as_they_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("start_s,end_s,label\n0,2,nrem_sws\n2,4,R\n4,5,Artifact\n")
    rows = {(r.label, r.l_start, r.l_end) for r in tb.read_labels(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {("NREM", 0.0, 2.0), ("REM", 2.0, 4.0), ("Wake", 4.0, 5.0)}
    assert tb.read_labels(spark, str(tmp_path / "a.csv"), drop_artifact=True).count() == 2
    (tmp_path / "b.csv").write_text("start_s,end_s,label\n0,2,N\n2,4,dozing\n")
    with pytest.raises(Exception, match="unknown label dozing"):
        tb.read_labels(spark, str(tmp_path / "b.csv")).collect()
    assert [r.raw_label for r in tb.read_labels(spark, str(tmp_path / "b.csv"), strict=False).collect()] == ["N"]
    (tmp_path / "c.csv").write_text("start_s,end_s,label\n2,2,N\n")
    with pytest.raises(Exception, match="ends in order"):
        tb.read_labels(spark, str(tmp_path / "c.csv")).collect()


def test_event_tree(spark):
    rows = [(1, "A-1", "s1", u, d) for u, d in ((1, 120.0), (1, 120.0), (2, 80.0))] + [(1, "B-1", "s1", 3, -1.0), (2, "C-1", "s2", 4, None), (2, "C-1", None, 5, 1.0)]
    e = spark.createDataFrame(rows, "dmd int, group_id string, owner_id string, unit_id int, owner_depth double")
    got = {(r.owner_id, r.group_id): (r.dmd, r.n_units, r.depths) for r in ck.event_tree(e).collect()}
    assert got == {("s1", "A-1"): (1, 2, [80.0, 120.0]), ("s1", "B-1"): (1, 1, []), ("s2", "C-1"): (2, 1, [])}
    listed = spark.createDataFrame([("s1", 7, 300.0)], "owner_id string, dmd int, owner_depth double")
    with_listed = {(r.owner_id, r.group_id): (r.dmd, r.depths) for r in ck.event_tree(e, metadata=listed).collect()}
    assert with_listed == {("s1", "A-1"): (7, [300.0]), ("s1", "B-1"): (7, [300.0]), ("s2", "C-1"): (2, [])}
    with pytest.raises(Exception, match="listed under more than one"):
        ck.event_tree(e, metadata=listed.union(spark.createDataFrame([("s1", 8, 1.0)], listed.schema))).collect()


def test_coverage_within_a_recordings_own_bounds(spark):
    s = spark.createDataFrame([(1, "N", 0.0, 10.0), (1, "W", 10.0, 20.0), (2, "N", 0.0, 4.0)], "rec int, state string, start_time double, end_time double")
    b = spark.createDataFrame([(1, 5.0, 9.0), (2, 0.0, 8.0)], "rec int, t0 double, t1 double")
    assert {(r.rec, r.state): (r.seconds, r.share) for r in iv.recording_coverage(s, b, ["rec"]).collect()} == {(1, "N"): (4.0, 1.0), (1, "W"): (0.0, 0.0), (2, "N"): (4.0, 0.5)}


def test_powers_with_and_without_logarithm(spark):
    x = spark.createDataFrame([(1, i, float(np.sin(0.3 * i) + np.cos(1.1 * i))) for i in range(256)], "epoch int, sample_idx long, value double")
    a, b = (sc.spectral_features(x, ["epoch"], 64.0, log=k).first() for k in (True, False))
    assert np.log(b.power_theta + 1e-12) == pytest.approx(a.log_theta) and a.entropy == b.entropy
