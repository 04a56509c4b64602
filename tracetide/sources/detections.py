"""Events by signal to noise and their outputs: detected, stored under a marker, and read with labels and clock offsets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.operators import signals as sg
from tracetide.operators.clock import pulses, reconcile_pulses
from tracetide.operators.events import run_events

#: Seconds a sensor takes to fall to 1/e, of the noise window, and noise levels that a sample must exceed.
TAU, NOISE_WINDOW, FACTOR = 0.026, 8.0, 4.0


def signal_and_noise(trace: DataFrame, keys: list[str], fs: float, mode: str = "matched", tau: float = TAU, noise_window: float = NOISE_WINDOW, min_valid: float = 0.5) -> DataFrame:
    """`keys, sample_idx, value, noise`: the matched-filter output, or with mode `denoised` the trace as it is, and its rolling noise."""
    if mode not in ("matched", "denoised"):
        raise ValueError(f"modes are matched and denoised, not {mode}")
    own = trace.select(*keys, "sample_idx", "value")
    if mode == "matched":
        own = sg.matched_filter(own, keys, sg.decay_kernel(tau, fs), min_valid=min_valid).select(*keys, "sample_idx", F.col("filtered").alias("value"))
    return sg.rolling_mad_noise(own, keys, noise_window, fs).select(*keys, "sample_idx", "value", F.col("mad").alias("noise"))


def noise_events(measured: DataFrame, keys: list[str], fs: float, factor: float = FACTOR) -> DataFrame:
    """Runs of samples above `factor` times the noise, with `time` and `peak_time` in seconds of the trial clock."""
    snr = measured.withColumn("snr", F.col("value") / F.greatest(F.col("noise") * factor, F.lit(1e-12)))
    return run_events(snr, keys, 1.0, fs).withColumns({"time": F.col("start_sample") / fs, "peak_time": F.col("peak_sample") / fs})


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def due(spark: SparkSession, marks: str, versions: DataFrame, recording: str, settings: str) -> DataFrame:
    """`(recording, source_version, settings)` of the recordings that have no marker with this source version and settings."""
    want = versions.select(recording, F.col("source_version").cast("string").alias("source_version"), F.lit(settings).alias("settings"))
    if _exists(spark, marks):
        have = spark.read.parquet(marks).select(F.col(recording).cast(want.schema[recording].dataType).alias(recording), "source_version", "settings")
        want = want.join(have, [recording, "source_version", "settings"], "left_anti")
    return spark.createDataFrame(want.collect(), want.schema)  # a row for each recording that is to be built


def put(tables: Iterable[tuple[str, DataFrame]], todo: DataFrame, out: str, recording: str) -> None:
    """Writes tables under `out`, a partition for each recording, replacing only those in `todo`; the marker that makes
    them count comes last, so that a run which ends early is done again."""
    rows = [(name, df.join(F.broadcast(todo), recording)) for name, df in tables]
    for name, df in [*rows, ("marks", todo)]:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(recording).parquet(f"{out}/{name}")


def refresh_events(spark: SparkSession, trace: DataFrame, out: str, recording: str, keys: list[str], versions: DataFrame, fs: float, mode: str = "matched", tau: float = TAU, noise_window: float = NOISE_WINDOW, min_valid: float = 0.5, factor: float = FACTOR) -> DataFrame:
    """Detects the events of recordings whose stored outputs are absent or of another version or settings; returns those.

    Three outputs under `out/<mode>`: `events`, `filtered` (of mode matched) and `noise`, on the trial clock. The modes
    don't touch each other's. trace: `keys (with the recording among them), sample_idx, value`.
    """
    rest = json.dumps([fs, tau if mode == "matched" else None, noise_window, min_valid if mode == "matched" else None, factor])
    at = f"{out}/{mode}"
    todo = due(spark, f"{at}/marks", versions, recording, hashlib.sha256(rest.encode()).hexdigest()[:16])
    own = trace.join(F.broadcast(todo.select(recording)), recording, "left_semi")
    measured = signal_and_noise(own, keys, fs, mode, tau, noise_window, min_valid)
    tables = [("noise", measured.select(*keys, "sample_idx", "noise"))]
    if mode == "matched":
        tables.append(("filtered", measured.select(*keys, "sample_idx", F.col("value").alias("filtered"))))
    put([*tables, ("events", noise_events(measured, keys, fs, factor))], todo, at, recording)
    return todo


def _marked(spark: SparkSession, out: str, mode: str, name: str, recording: str) -> DataFrame:
    """Only recordings whose marker says the same version and settings as their rows."""
    marks = spark.read.parquet(f"{out}/{mode}/marks").select(recording, "source_version", "settings")
    return spark.read.parquet(f"{out}/{mode}/{name}").join(marks, [recording, "source_version", "settings"])


def with_labels(df: DataFrame, labels: DataFrame | None, on: list[str]) -> DataFrame:
    """Unit labels beside the rows, null where a unit has none; columns that both have stay the rows' own."""
    if labels is None:
        return df
    return df.join(labels.select(*on, *[c for c in labels.columns if c not in df.columns]).dropDuplicates(on), on, "left")


def with_offset(df: DataFrame, offsets: DataFrame | None, recording: str, times: list[str]) -> DataFrame:
    """Times on the shared clock: `offsets(recording, offset)` is added; a recording without one is an error when it is read."""
    if offsets is None:
        return df
    known = df.join(offsets.select(recording, F.col("offset").cast("double").alias("__offset")), recording, "left")
    offset = F.when(F.col("__offset").isNull(), F.raise_error(F.concat(F.lit("no offset for "), F.col(recording).cast("string"))).cast("double")).otherwise(F.col("__offset"))
    return known.withColumns({t: F.col(t) + offset for t in times}).drop("__offset")


def read_events(spark: SparkSession, out: str, recording: str, mode: str = "matched", labels: DataFrame | None = None, offsets: DataFrame | None = None, on: tuple[str, ...] = ("unit_id",), recordings: list | None = None) -> DataFrame:
    """Stored events with the units' labels, their times on the shared clock where offsets are given."""
    df = _marked(spark, out, mode, "events", recording)
    df = df if recordings is None else df.where(F.col(recording).isin(recordings))
    return with_offset(with_labels(df, labels, list(on)), offsets, recording, ["time", "peak_time"])


def read_samples(spark: SparkSession, out: str, recording: str, fs: float, name: str = "filtered", mode: str = "matched", labels: DataFrame | None = None, offsets: DataFrame | None = None, on: tuple[str, ...] = ("unit_id",), recordings: list | None = None, units: list | None = None) -> DataFrame:
    """A stored output by sample (`filtered` or `noise`) with `time`, labels and offsets as `read_events`; recordings and
    units are picked before anything else."""
    df = _marked(spark, out, mode, name, recording)
    df = df if recordings is None else df.where(F.col(recording).isin(recordings))
    df = df if units is None else df.where(F.col("unit_id").isin(units))
    return with_offset(with_labels(df.withColumn("time", F.col("sample_idx") / fs), labels, list(on)), offsets, recording, ["time"])


def refresh_frame_clock(spark: SparkSession, signal: DataFrame, frames: DataFrame, out: str, recording: str, versions: DataFrame, fs: float, factor: float = 3.0, least: int = 20) -> DataFrame:
    """Stores the frame times of blocks whose stored ones are absent or of another version or settings; returns those blocks.

    signal: `recording, sample_idx, value` of the sync channel; frames: `recording, n_frames`. Rising edges are cut or
    carried on to the number of frames; `frame_clock` has `recording, frame, pulse, time`.
    """
    todo = due(spark, f"{out}/marks", versions, recording, hashlib.sha256(json.dumps([fs, factor, least]).encode()).hexdigest()[:16])
    own = signal.join(F.broadcast(todo.select(recording)), recording, "left_semi")
    clock = reconcile_pulses(pulses(own, [recording], factor, least), frames, [recording])
    put([("frame_clock", clock.withColumn("time", F.col("pulse") / fs))], todo, out, recording)
    return todo
