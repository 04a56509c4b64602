"""Epoch features, classification and duration-aware decoding of state sequences."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.functions.rules import standard_label

#: Names under which states come, and the bands of power features in Hz.
ALIASES = {"NREM": "NREM", "NREM_SWS": "NREM", "SWS": "NREM", "N": "NREM", "REM": "REM", "R": "REM", "WAKE": "Wake", "W": "Wake", "ARTIFACT": "Wake"}
BANDS = {"delta": (0.5, 4.0), "theta": (5.0, 10.0), "sigma": (10.0, 15.0), "beta": (15.0, 30.0), "gamma": (30.0, 80.0)}
STATES = ["NREM", "REM", "Wake"]
#: Epochs of whole sessions that are decoded together.
DECODED = 1 << 16


def epoch_grid(ranges: DataFrame, length: float, key: str = "session_id") -> DataFrame:
    """`key, epoch_idx, e_start, e_end` over what all modalities of a session cover. ranges: `key, t0, t1`."""
    s = ranges.groupBy(key).agg(F.max("t0").alias("a"), F.min("t1").alias("b")).withColumn("n", F.floor((F.col("b") - F.col("a")) / length)).where("n >= 1")
    k = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return s.withColumn("epoch_idx", k).select(key, "epoch_idx", (F.col("a") + F.col("epoch_idx") * length).alias("e_start"), (F.col("a") + (F.col("epoch_idx") + 1) * length).alias("e_end"))


def standard_labels(labels: DataFrame, raw: str = "label", drop_artifact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with a known state, rows without): labels are trimmed, upper-cased and mapped; the raw one is kept."""
    out = labels.withColumnRenamed(raw, "raw_label").withColumn("label", standard_label(F.col("raw_label"), ALIASES))
    if drop_artifact:
        out = out.where(F.coalesce(F.upper(F.trim("raw_label")), F.lit("")) != "ARTIFACT")
    return out.where("label is not null"), out.where("label is null")


def video_masks(frames: DataFrame, key: str, likely: float = 0.2) -> DataFrame:
    """Flags of frames: pupil, motion (the frame before is good too), eyelid and whisking valid; camera off."""
    w = W.partitionBy(key).orderBy("frame")
    low = frames.groupBy(key).agg(F.percentile("whisking", F.lit(0.05)).alias("__low"))
    pupil = F.coalesce((F.col("pup_likelihood") > likely) & F.col("diameter").isNotNull(), F.lit(False))
    lid = F.coalesce((F.col("lid_likelihood") > likely) & F.col("eyelid").isNotNull(), F.lit(False))
    out = frames.join(low, key).withColumns({"pupil_ok": pupil, "eyelid_ok": lid, "whisk_ok": F.col("whisking").isNotNull()})
    off = (F.col("pup_likelihood") <= likely) & (F.col("lid_likelihood") <= likely) & (F.col("whisking") <= F.col("__low"))
    return out.withColumns({"motion_ok": F.col("pupil_ok") & F.coalesce(F.lag("pupil_ok").over(w), F.lit(False)), "camera_off": F.coalesce(off, F.lit(False))}).drop("__low")


def epoch_statistics(samples: DataFrame, keys: list[str], value: str, expected: int, name: str) -> DataFrame:
    """Mean, population spread, IQR, mean speed and coverage of an epoch's values; null below half the samples."""
    w = W.partitionBy(*keys).orderBy("sample_idx")
    at = samples.withColumn("__v", F.abs(F.col(value) - F.lag(value).over(w)))
    ok = F.count(value) >= 0.5 * expected
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    s = at.groupBy(*keys).agg(F.when(ok, F.avg(value)).alias(f"{name}_mean"), F.when(ok, F.stddev_pop(value)).alias(f"{name}_std"), F.when(ok, q).alias("__q"), F.when(ok, F.avg("__v")).alias(f"{name}_speed"), (F.count(value) / expected).alias(f"{name}_valid"))
    return s.withColumn(f"{name}_iqr", F.element_at("__q", 2) - F.element_at("__q", 1)).drop("__q")


def bout_activity(samples: DataFrame, keys: list[str], session: str, value: str) -> DataFrame:
    """Share of samples above the session's median + 3 MAD, and upward crossings of that level, per epoch."""
    mid = samples.groupBy(session).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    dev = samples.join(mid, session).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    level = dev.groupBy(session).agg((F.first("__m") + 3 * F.percentile("__d", F.lit(0.5))).alias("__l"))
    w = W.partitionBy(*keys).orderBy("sample_idx")
    at = samples.join(level, session).withColumn("__up", F.col(value) > F.col("__l"))
    return at.withColumn("__was", F.lag("__up").over(w)).groupBy(*keys).agg(F.avg(F.col("__up").cast("int")).alias("active_share"), F.count_if(F.col("__up") & ~F.col("__was")).alias("crossings"))


def spectrum(x: np.ndarray, fs: float, segment: int, bands: dict[str, tuple[float, float]], log: bool = True) -> list[float]:
    """Band powers, entropy, 95 % edge and line length of samples without gaps: Welch with Hann windows that half overlap."""
    n = min(segment, len(x))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = [x[s : s + n] for s in range(0, len(x) - n + 1, max(1, n // 2))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * hann)) ** 2 for p in parts], 0) / (fs * (hann**2).sum())
    power[1 : len(power) - (n % 2 == 0)] *= 2  # one side stands for both
    freq = np.fft.rfftfreq(n, 1 / fs)
    total = power.sum()
    p = power / total if total > 0 else np.full(len(power), 1 / len(power))
    powers = [float(np.trapezoid(power[(freq >= a) & (freq < b)], freq[(freq >= a) & (freq < b)])) for a, b in bands.values()]
    powers = [math.log(v + 1e-12) for v in powers] if log else powers
    return [*powers, float(-(p[p > 0] * np.log(p[p > 0])).sum()), float(freq[np.searchsorted(np.cumsum(p), 0.95).clip(0, len(freq) - 1)]), float(np.abs(np.diff(x)).sum() / len(x))]


def spectrum_names(bands: dict[str, tuple[float, float]], log: bool = True) -> list[str]:
    return [f"{'log' if log else 'power'}_{b}" for b in bands] + ["entropy", "edge95", "line_length"]


def spectral_features(samples: DataFrame, keys: list[str], fs: float, segment: int = 128, least: int = 8, bands: dict[str, tuple[float, float]] = BANDS, log: bool = True) -> DataFrame:
    """Log band powers, entropy, 95 % edge and line length of each key's samples (an epoch): see `spectrum`.
    Without `log` powers are as they are and named `power_<band>`.

    Epochs are small and many, so each is one group; below `least` samples the features are null.
    """
    names = spectrum_names(bands, log)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema)

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows.sort_by("sample_idx").column("value").to_numpy()
        x = x[np.isfinite(x)]
        found = spectrum(x, fs, segment, bands, log) if len(x) >= max(2, least) and segment > 1 else [None] * len(names)
        own = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table(own | {c: pa.array([v], pa.float64()) for c, v in zip(names, found, strict=True)})

    return samples.select(*keys, "sample_idx", F.col("value").cast("double").alias("value")).groupBy(*keys).applyInArrow(solve, f"{kinds}, " + ", ".join(f"{c} double" for c in names))


def context_features(df: DataFrame, session: str, cols: list[str], windows: tuple[int, ...] = (5, 15, 60)) -> DataFrame:
    """Centred rolling means, the spread over the first window, and differences back; null where the value is."""
    out, w = {}, W.partitionBy(session).orderBy("epoch_idx")
    for c in cols:
        have = F.col(c).isNotNull()
        for k in windows:
            frame = w.rowsBetween(-(k // 2), k - 1 - k // 2)
            ok = have & (F.count(c).over(frame) >= max(3, k // 3))
            out[f"{c}_mean{k}"] = F.when(ok, F.avg(c).over(frame))
            if k == windows[0]:
                out[f"{c}_std{k}"] = F.when(ok, F.stddev_samp(c).over(frame))
        for k in windows[:2]:
            out[f"{c}_diff{k}"] = F.col(c) - F.lag(c, k).over(w)
    return df.withColumns(out)


def robust_scale(df: DataFrame, session: str, cols: list[str]) -> DataFrame:
    """(x - median) / IQR per session; an IQR of 0 or null counts as 1."""
    s = df.groupBy(session).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__{c}") for c in cols])
    at = df.join(s, session)
    iqr = lambda c: F.element_at(f"__{c}", 3) - F.element_at(f"__{c}", 1)
    return at.withColumns({c: (F.col(c) - F.element_at(f"__{c}", 2)) / F.when(F.coalesce(iqr(c), F.lit(0.0)) == 0, 1.0).otherwise(iqr(c)) for c in cols}).drop(*[f"__{c}" for c in cols])


def impute(df: DataFrame, session: str, cols: list[str]) -> DataFrame:
    """Null and NaN become the session's median, 0 if it has none."""
    clean = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols})
    s = clean.groupBy(session).agg(*[F.percentile(c, F.lit(0.5)).alias(f"__{c}") for c in cols])
    return clean.join(s, session).withColumns({c: F.coalesce(c, f"__{c}", F.lit(0.0)) for c in cols}).drop(*[f"__{c}" for c in cols])


def varying(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns whose variance is finite and not 0; one row comes to the driver."""
    v = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    kept = [c for c in cols if v[c] is not None and math.isfinite(v[c]) and v[c] > 1e-12]
    if not kept:
        raise ValueError("no feature varies")
    return kept


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """`weight`: inverse class counts, scaled to add up to the number of rows."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.sum(1 / F.col("__n") * F.col("__n")).alias("__k"))
    return df.join(F.broadcast(n.crossJoin(total)), label).withColumn("weight", F.col("__all") / (F.col("__n") * F.col("__k"))).drop("__n", "__all", "__k")


@dataclass
class StateModel:
    """A forest and one logistic calibration a class, with what they need to be applied."""

    cols: list[str]
    states: list[str]
    forest: object
    calibration: dict = field(default_factory=dict)


def save_model(spark: SparkSession, model: StateModel, path: str) -> None:
    """Writes the forest and what else the model needs under `path`, replacing what is there."""
    model.forest.write().overwrite().save(f"{path}/forest")
    rest = json.dumps({"cols": model.cols, "states": model.states, "calibration": model.calibration})
    spark.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> StateModel:
    from pyspark.ml.classification import RandomForestClassificationModel

    rest = json.loads(spark.read.text(f"{path}/model").first()[0])
    return StateModel(rest["cols"], rest["states"], RandomForestClassificationModel.load(f"{path}/forest"), {s: tuple(c) for s, c in rest["calibration"].items()})


def importance(spark: SparkSession, model: StateModel, n: int = 20) -> DataFrame:
    """`feature, importance` of the n features that matter most to the forest; a report."""
    rows = [(c, float(v)) for c, v in zip(model.cols, model.forest.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def smoothed_label(df: DataFrame, session: str, states: list[str], window: int, out: str = "pred_label") -> DataFrame:
    """The state with the largest mean probability over a centred window of epochs."""
    w = W.partitionBy(session).orderBy("epoch_idx").rowsBetween(-(window // 2), window - 1 - window // 2)
    names = {f"P_{s}": F.avg(f"P_{s}").over(w) for s in states}
    picked = argmax_label(df.select(session, "epoch_idx", *[v.alias(k) for k, v in names.items()]), states, out)
    return df.join(picked.select(session, "epoch_idx", out), [session, "epoch_idx"])


def zero_crossings(samples: DataFrame, keys: list[str]) -> DataFrame:
    """How often the sign changes along an epoch; 0 counts as positive."""
    sign = F.col("value") < 0
    return samples.withColumn("__s", sign != F.lag(sign).over(W.partitionBy(*keys).orderBy("sample_idx"))).groupBy(*keys).agg(F.count_if("__s").alias("crossings"))


def train_states(df: DataFrame, cols: list[str], states: list[str], label: str = "label", seed: int = 0, folds: int = 5, isotonic: bool = False) -> StateModel:
    """Fits a class-weighted forest on all folds but one and calibrates it on the rest; all states must occur.

    The calibration is a logistic curve a state, or with `isotonic` a rising step curve, joined by straight lines.

    df: complete feature columns, `label` and a long `row_id` that deals the folds.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    found = {r[0] for r in df.select(label).distinct().limit(len(states) + 1).collect()}
    if found != set(states):
        raise ValueError(f"labels are {sorted(map(str, found))}, not {states}")
    cols = varying(df, cols)
    y = F.array_position(F.array(*[F.lit(s) for s in states]), F.col(label)).cast("double") - 1
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(balanced_weights(df, label)).select("row_id", "features", "weight", y.alias("y"))
    fold = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(folds))
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="weight", numTrees=40, maxDepth=8, seed=seed).fit(rows.where(fold != 0))
    held = forest.transform(rows.where(fold == 0)).withColumn("p", vector_to_array("probability"))
    model = StateModel(cols, states, forest)
    for k, s in enumerate(states):
        one = VectorAssembler(inputCols=["x"], outputCol="v").transform(held.select(F.col("p")[k].alias("x"), (F.col("y") == k).cast("double").alias("t")))
        if isotonic:
            curve = IsotonicRegression(labelCol="t", featuresCol="x").fit(one)
            model.calibration[s] = ([float(x) for x in curve.boundaries.toArray()], [float(x) for x in curve.predictions.toArray()])
            continue
        fit = LogisticRegression(labelCol="t", featuresCol="v", regParam=1e-3).fit(one)
        model.calibration[s] = (float(fit.coefficients[0]), float(fit.intercept))
    return model


def _calibrated(p: Column, a: float | list[float], b: float | list[float]) -> Column:
    """A logistic curve by slope and intercept, or a polygon by its corners, of which there may be many."""
    if not isinstance(a, list):
        return 1 / (1 + F.exp(-(p * a + b)))
    return F.pandas_udf(lambda x: pd.Series(np.interp(x, a, b)), "double")(p)


def state_probabilities(df: DataFrame, model: StateModel) -> DataFrame:
    """`P_<state>` columns that add up to 1, none below 1e-12."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = model.forest.transform(VectorAssembler(inputCols=model.cols, outputCol="features").transform(df)).withColumn("__p", vector_to_array("probability"))
    raw = {s: F.greatest(F.lit(1e-12), _calibrated(F.col("__p")[k], *model.calibration[s])) for k, s in enumerate(model.states)}
    total = reduce(lambda a, b: a + b, raw.values())
    return out.withColumns({f"P_{s}": v / total for s, v in raw.items()}).drop("__p", "features", "rawPrediction", "probability", "prediction")


def argmax_label(df: DataFrame, states: list[str], out: str = "pred_label") -> DataFrame:
    """The state with the largest `P_<state>`, the first of equal ones."""
    p = F.array(*[F.col(f"P_{s}") for s in states])
    return df.withColumn(out, F.element_at(F.array(*[F.lit(s) for s in states]), F.array_position(p, F.array_max(p)).cast("int")))


@dataclass
class Durations:
    """Log transition matrix, and log-normal durations cut at `longest` epochs. `build` rules self transitions out."""

    states: list[str]
    log_transition: np.ndarray
    log_duration: np.ndarray

    @classmethod
    def smooth(cls, states: list[str], mean_s: dict[str, float], epoch_s: float, smoothness: float = 0.5, sigma: float = 0.75, longest_s: float = 300.0, stay: float = 0.2, change: float = -0.8) -> "Durations":
        """Segments that may follow one of the same state. `smoothness` from 0 to 1 makes means longer (0.6 to 1.8 times)
        and scales what staying gains and changing costs (0.5 to 1.5 times); durations are log-normal with these means."""
        n, longest = len(states), max(1, int(longest_s // epoch_s))
        t = np.full((n, n), math.log(0.05) + change * (0.5 + smoothness))
        np.fill_diagonal(t, math.log(0.90) + stay * (0.5 + smoothness))
        t -= np.logaddexp.reduce(t, axis=1)[:, None]
        d = np.log(np.arange(1, longest + 1))
        mu = [math.log(max(mean_s[s] * (0.6 + 1.2 * min(1.0, max(0.0, smoothness))) / epoch_s, 1e-6)) - sigma**2 / 2 for s in states]
        log_d = np.array([-d - (d - m) ** 2 / (2 * sigma**2) for m in mu])
        return cls(states, t, log_d - np.logaddexp.reduce(log_d, axis=1)[:, None])

    @classmethod
    def build(cls, states: list[str], median_s: dict[str, float], sigma: dict[str, float], epoch_s: float, longest_s: float = 450.0, scale: dict[tuple[str, str], float] | None = None) -> "Durations":
        n, longest = len(states), max(1, int(longest_s // epoch_s))
        t = np.ones((n, n)) - np.eye(n)
        for (a, b), f in (scale or {}).items():
            t[states.index(a), states.index(b)] *= f
        t = t / np.maximum(t.sum(1, keepdims=True), 1e-300)
        d = np.arange(1, longest + 1) * epoch_s
        log_d = np.array([-np.log(d * sigma[s]) - (np.log(d) - math.log(median_s[s])) ** 2 / (2 * sigma[s] ** 2) for s in states])
        log_d -= np.log(np.exp(log_d - log_d.max(1, keepdims=True)).sum(1, keepdims=True)) + log_d.max(1, keepdims=True)
        with np.errstate(divide="ignore"):
            return cls(states, np.log(t), log_d)


def viterbi(log_p: np.ndarray, model: Durations) -> np.ndarray:
    """Explicit-duration Viterbi; ties keep the first state and the shortest duration. log_p: epochs x states."""
    return viterbi_side_by_side(log_p[:, None], np.array([len(log_p)]), model)[:, 0]


def viterbi_side_by_side(log_p: np.ndarray, lengths: np.ndarray, model: Durations) -> np.ndarray:
    """The same for sessions that advance together, longest first. log_p: epochs x sessions x states; what comes back,
    epochs x sessions, means nothing beyond a session's length."""
    steps, m, n = log_p.shape
    total = np.concatenate([np.zeros((1, m, n)), np.cumsum(log_p, 0)])
    enter = np.full((steps + 1, m, n), -np.inf)  # the best score of all before an epoch, on entering a state there, and from where
    source = np.full((steps + 1, m, n), -1, np.int32)
    enter[0] = -math.log(n)
    length = np.zeros((steps + 1, m, n), np.int32)
    state = np.zeros(m, int)
    for t in range(1, steps + 1):
        longest, a = min(t, model.log_duration.shape[1]), int(np.searchsorted(-lengths, -t, "right"))
        score = enter[t - longest : t, :a][::-1] + model.log_duration[:, :longest].T[:, None] + total[t, :a] - total[t - longest : t, :a][::-1]
        d = score.argmax(0)
        best = np.take_along_axis(score, d[None], 0)[0]
        length[t, :a] = d + 1
        into = best[:, :, None] + model.log_transition
        source[t, :a] = into.argmax(1)
        enter[t, :a] = into.max(1)
        done = slice(int(np.searchsorted(-lengths, -t, "left")), a)
        state[done] = best[done].argmax(1)
    out, at, who = np.full((steps, m), -1), lengths.copy(), np.flatnonzero(lengths)
    while len(who):  # segments from the last to the first, each marked at its first epoch
        s = state[who]
        first = at[who] - length[at[who], who, s]
        out[first, who] = s
        state[who], at[who] = source[first, who, s], first
        who = who[first > 0]
    kept = np.maximum.accumulate(np.where(out >= 0, np.arange(steps)[:, None], 0), 0)
    return np.take_along_axis(out, kept, 0)


def _starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where another id begins than the one before; null is an id."""
    ids = ids.combine_chunks()
    a, b = ids[1:], ids[:-1]
    return np.append(0, np.flatnonzero(pa.compute.coalesce(pa.compute.not_equal(a, b), pa.compute.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)) + 1)


def decode_sessions(probabilities: DataFrame, model: Durations, session: str = "session_id") -> DataFrame:
    """`session, epoch_idx, state` by Viterbi over each session's epochs; sessions of about one length advance together, of
    `DECODED` epochs in all or one session."""
    kind = probabilities.schema[session].dataType.simpleString()
    columns = [f"P_{s}" for s in model.states]

    def decoded(rows: pa.Table) -> pa.Table:
        log_p = np.log(np.column_stack([rows.column(c).to_numpy() for c in columns]).astype(float).clip(1e-12))
        first = _starts(rows.column(session))
        n = np.diff(np.append(first, len(log_p)))
        path, size = np.empty(len(log_p), int), np.frexp(n)[1]
        for k in np.unique(size):
            own = np.flatnonzero(size == k)
            own = own[np.argsort(-n[own], kind="stable")]
            epoch = np.arange(n[own[0]])[:, None]
            have = epoch < n[own]
            at = np.where(have, first[own] + epoch, 0)
            path[at[have]] = viterbi_side_by_side(np.where(have[:, :, None], log_p[at], 0.0), n[own], model)[have]
        return rows.select([session, "epoch_idx"]).append_column("state", pa.array(np.array(model.states, object)[path], pa.string()))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = [], DECODED
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < least:
                continue
            rows = pa.Table.from_batches(held)
            last = int(_starts(rows.column(session))[-1])
            if last:
                yield from decoded(rows.slice(0, last)).to_batches()
            held = rows.slice(last).to_batches()
            least = max(DECODED, 2 * (len(rows) - last))
        if sum(b.num_rows for b in held):
            yield from decoded(pa.Table.from_batches(held)).to_batches()

    rows = probabilities.select(session, F.col("epoch_idx").cast("long").alias("epoch_idx"), *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.repartition(session).sortWithinPartitions(session, "epoch_idx").mapInArrow(solve, f"`{session}` {kind}, epoch_idx long, state string")


def bouts_from_epochs(epochs: DataFrame, session: str, label: str, means: list[str]) -> DataFrame:
    """Runs of one label with their bounds, number of epochs and the means of columns."""
    w = W.partitionBy(session).orderBy("epoch_idx")
    island = F.sum((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")).over(w)
    return epochs.withColumn("__i", island).groupBy(session, "__i", label).agg(F.min("epoch_idx").alias("first_epoch"), F.max("epoch_idx").alias("last_epoch"), F.count(F.lit(1)).alias("n_epochs"), *[F.avg(c).alias(f"mean_{c}") for c in means]).drop("__i")


def force_state(epochs: DataFrame, label: str, state: str, threshold: float | None = 0.8) -> DataFrame:
    """Epochs whose probability of `state` reaches the threshold get it; none if it is None."""
    return epochs if threshold is None else epochs.withColumn(label, F.when(F.col(f"P_{state}") >= threshold, state).otherwise(F.col(label)))


def untrainable(df: DataFrame, subject: str, label: str = "label") -> DataFrame:
    """`(subject, label)`: subjects that alone have a state, so that the others can't teach it."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(subject).alias(subject), F.max(subject).alias("__top")).where(F.col(subject).eqNullSafe(F.col("__top"))).select(subject, label)


def leave_one_out(df: DataFrame, cols: list[str], states: list[str], subject: str, threads: int = 4) -> DataFrame:
    """Predicted labels of each subject by a model of the others, models fitted side by side; subjects that `untrainable`
    lists are left out."""
    alone = {r[0] for r in untrainable(df, subject).select(subject).collect()}
    who = [r[0] for r in df.select(subject).distinct().orderBy(subject).collect() if r[0] not in alone]
    rows = df.persist()
    try:

        def one(name) -> DataFrame:
            model = train_states(rows.where(F.col(subject) != name), cols, states)
            return argmax_label(state_probabilities(df.where(F.col(subject) == name), model), states).select("row_id", subject, "label", "pred_label")

        with ThreadPool(max(1, min(threads, len(who)))) as pool:
            parts = pool.map(inheritable_thread_target(df.sparkSession)(one), who)
    finally:
        rows.unpersist()
    none = df.select("row_id", subject, "label", F.col("label").cast("string").alias("pred_label")).where(F.lit(False))
    return reduce(lambda a, b: a.unionByName(b), parts, none)
