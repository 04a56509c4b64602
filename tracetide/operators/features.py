"""Epoch features of eye, whisking and video-quality frames and of voltage windows, and the table of all of them.

frames: `keys (a session and epoch_idx), frame, t`, the measured columns, and the flags of `scoring.video_masks`.
Each family is one pass over windows of an epoch and one aggregation; epochs are small and many.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.operators import scoring as sc

#: Seconds of the voltage windows, the eye opening below which it counts as closed, the share of frames
#: that make an epoch one without camera.
WINDOWS_S, CLOSED, CAMERA_OFF = (1.0, 2.0, 4.0), 0.3, 0.8
#: Epochs of a session that are one group.
EPOCHS = 64
#: Bands in Hz of the shortest window and of longer ones.
BANDS_SHORT = {"delta": (0.5, 4.0), "delta1": (0.5, 2.0), "delta2": (2.0, 4.0), "theta": (6.0, 10.0), "sigma": (10.0, 15.0), "spindle": (11.0, 16.0), "beta": (15.0, 30.0), "lgamma": (30.0, 55.0), "ugamma": (52.0, 70.0), "hgamma": (55.0, 90.0)}
BANDS_LONG = {"delta": (0.5, 4.0), "theta": (6.0, 10.0), "sigma": (10.0, 15.0), "spindle": (11.0, 16.0), "lgamma": (30.0, 55.0), "ugamma": (52.0, 70.0)}


def _least(fs: float, epoch_s: float) -> int:
    return max(int(0.5 * fs * epoch_s), 2)


def _iqr(x: Column) -> Column:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    return q[1] - q[0]


def pupil_features(frames: DataFrame, keys: list[str], fs: float, epoch_s: float) -> DataFrame:
    """Size, speed, motion and eyelid features of an epoch's valid frames; null below half of the expected ones.

    Speed is between successive valid frames with time between them; `constriction_rate` is the share that shrinks.
    """
    least = _least(fs, epoch_s)
    before = F.last(F.when(F.col("pupil_ok"), F.struct("t", "diameter")), True).over(W.partitionBy(*keys).orderBy("frame").rowsBetween(W.unboundedPreceding, -1))
    dt = F.col("t") - F.col("__b.t")
    speed = F.when(F.col("pupil_ok") & (dt > 0), (F.col("diameter") - F.col("__b.diameter")) / F.when(dt > 0, dt))
    at = frames.withColumn("__b", before).withColumn("__v", speed)
    own = lambda flag, c: F.when(F.col(flag), F.col(c))
    families = {
        "pupil_ok": {"diam_mean": F.avg(own("pupil_ok", "diameter")), "diam_std": F.stddev_pop(own("pupil_ok", "diameter")), "diam_iqr": _iqr(own("pupil_ok", "diameter")), "speed_mean": F.avg(F.abs("__v")), "speed_std": F.stddev_pop("__v"), "constriction_rate": F.avg(F.when(F.col("__v").isNotNull(), (F.col("__v") < 0).cast("int")))},
        "motion_ok": {"motion_mean": F.avg(own("motion_ok", "motion")), "motion_std": F.stddev_pop(own("motion_ok", "motion"))},
        "eyelid_ok": {"eyelid_mean": F.avg(own("eyelid_ok", "eyelid")), "eyelid_std": F.stddev_pop(own("eyelid_ok", "eyelid")), "eyelid_norm_mean": F.avg(own("eyelid_ok", "eyelid_norm")), "closed_share": F.avg(F.when(F.col("eyelid_ok"), (F.col("eyelid_norm") < CLOSED).cast("int")))},
    }
    return at.groupBy(*keys).agg(*[F.when(F.count_if(flag) >= least, x).alias(n) for flag, columns in families.items() for n, x in columns.items()])


def whisking_features(frames: DataFrame, keys: list[str], fs: float, epoch_s: float) -> DataFrame:
    """Mean, spread, IQR, share above the epoch's median + 3 MAD and upward crossings; null below half of the frames."""
    whole, along = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("frame")
    valid = frames.where("whisk_ok").withColumn("__m", F.percentile("whisking", F.lit(0.5)).over(whole))
    valid = valid.withColumn("__up", F.col("whisking") > F.col("__m") + 3 * (F.percentile(F.abs(F.col("whisking") - F.col("__m")), F.lit(0.5)).over(whole) + 1e-9))
    valid = valid.withColumn("__was", F.lag("__up").over(along))
    features = {"whisk_mean": F.avg("whisking"), "whisk_std": F.stddev_pop("whisking"), "whisk_iqr": _iqr(F.col("whisking")), "whisk_active": F.avg(F.col("__up").cast("int")), "whisk_bursts": F.count_if(F.col("__up") & ~F.col("__was"))}
    got = valid.groupBy(*keys).agg(*[F.when(F.count(F.lit(1)) >= _least(fs, epoch_s), x).alias(n) for n, x in features.items()])
    return frames.select(*keys).distinct().join(got, keys, "left")


def quality_features(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of valid frames by kind, the share without camera, and whether that makes the epoch one without."""
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    out = frames.groupBy(*keys).agg(share("pupil_ok").alias("pupil_share"), share("eyelid_ok").alias("eyelid_share"), share("whisk_ok").alias("whisk_share"), share("camera_off").alias("off_share"))
    return out.withColumn("camera_off_epoch", (F.col("off_share") >= CAMERA_OFF).cast("double"))


def voltage_features(samples: DataFrame, epochs: DataFrame, session: str, fs: float, windows_s: tuple[float, ...] = WINDOWS_S) -> DataFrame:
    """Spectral features of windows centred on each epoch, null below half of a window's samples.

    samples: `session, t, value`; epochs: `session, epoch_idx, e_start, e_end`. Windows are exploded over cells of
    the longest window, so samples meet them by equality; some epochs with all their windows are one group. The
    shortest window adds log ratios of bands.
    """
    longest, shortest, keys = max(windows_s), min(windows_s), [session, "epoch_idx"]
    cells = F.explode(F.sequence(F.floor((F.col("__c") - longest / 2) / longest), F.floor((F.col("__c") + longest / 2) / longest)))
    spans = epochs.withColumn("__c", (F.col("e_start") + F.col("e_end")) / 2).select(*keys, "__c").withColumn("__cell", cells)
    met = samples.withColumn("__cell", F.floor(F.col("t") / longest)).join(spans, [session, "__cell"])
    met = met.where((F.col("t") >= F.col("__c") - longest / 2) & (F.col("t") < F.col("__c") + longest / 2)).select(*keys, "__c", "t", F.col("value").cast("double").alias("value"))
    bands = {s: BANDS_SHORT if s == shortest else BANDS_LONG for s in windows_s}
    ratios = [(a, b) for a, b in (("theta", "delta"), ("theta", "sigma"), ("beta", "delta"), ("ugamma", "delta"))]
    own = {s: [*sc.spectrum_names(bands[s]), *[f"{a}_{b}" for a, b in ratios]] if s == shortest else sc.spectrum_names(bands[s])[: len(bands[s])] for s in windows_s}
    names = [f"{c}_{s:g}s" for s in windows_s for c in own[s]]

    def one(t: np.ndarray, x: np.ndarray) -> list[float | None]:
        """The features of an epoch from its samples, whose times are from its centre."""
        out: list[float | None] = []
        for s in windows_s:
            y = x[(t >= -s / 2) & (t < s / 2) & np.isfinite(x)]
            if len(y) < max(int(0.5 * fs * s), 8):
                out += [None] * len(own[s])
                continue
            found = sc.spectrum(y, fs, min(max(int(fs * 2), 8), 512), bands[s])
            power = dict(zip(bands[s], found, strict=False))
            more = [math.log((math.exp(power[a]) + 1e-9) / (math.exp(power[b]) + 1e-9)) for a, b in ratios] if s == shortest else []
            out += [*found, *more][: len(own[s])]
        return out

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("epoch_idx", "ascending"), ("t", "ascending")])
        epoch, t, x = (rows.column(c).to_numpy() for c in ("epoch_idx", "t", "value"))
        first = np.flatnonzero(np.append(True, epoch[1:] != epoch[:-1]))
        found = [one(t[a:b], x[a:b]) for a, b in zip(first, [*first[1:], len(epoch)], strict=True)]
        return pa.table({k: rows.column(k).take(first) for k in keys} | {c: pa.array([f[i] for f in found], pa.float64()) for i, c in enumerate(names)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*keys).schema)
    rows = met.withColumn("t", (F.col("t") - F.col("__c")).cast("double")).drop("__c").withColumn("__part", F.floor(F.col("epoch_idx") / EPOCHS))
    found = rows.groupBy(session, "__part").applyInArrow(solve, f"{kinds}, " + ", ".join(f"`{c}` double" for c in names))
    return epochs.select(*keys).join(found, keys, "left")


def feature_table(epochs: DataFrame, samples: DataFrame, frames: DataFrame, session: str, fs_samples: float, fs_frames: float, epoch_s: float) -> DataFrame:
    """One row an epoch with all features; null where a modality has too little of it.

    frames: `session, frame, t`, measures and flags; each goes to the epoch its time lies in, half open.
    """
    keys = [session, "epoch_idx"]
    grid = epochs.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("e_start") / epoch_s), F.floor(F.col("e_end") / epoch_s))))
    at = frames.withColumn("__cell", F.floor(F.col("t") / epoch_s)).join(grid, [session, "__cell"]).where("t >= e_start and t < e_end").drop("__cell", "e_start", "e_end")
    parts = [voltage_features(samples, epochs, session, fs_samples), pupil_features(at, keys, fs_frames, epoch_s), whisking_features(at, keys, fs_frames, epoch_s), quality_features(at, keys)]
    return reduce(lambda a, b: a.join(b, keys, "left"), parts, epochs)
