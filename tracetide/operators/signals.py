"""Filters, fills, noise and baselines along time, per unit. Missing samples are null and never interpolated silently."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetide.operators.blocks import SIZE, Recursion, cut, numbered, recur, with_halo


def _along(keys: list[str], a: int | None = None, b: int | None = None):
    w = W.partitionBy(*keys).orderBy("sample_idx")
    return w if a is None else w.rowsBetween(a, b)


def decay_kernel(tau: float, fs: float, rise: float | None = None, n_tau: float = 5.0) -> list[float]:
    """Exponential template of unit energy; with `rise`, a difference of exponentials floored at 0."""
    n = max(2, math.ceil(n_tau * tau * fs))
    t = np.arange(n) / fs
    h = np.exp(-t / tau)
    if rise:
        h = np.maximum(h - np.exp(-t / rise), 0)
    return (h / np.sqrt((h**2).sum())).tolist()


def unit_sum_kernel(tau: float, fs: float, n_tau: float = 8.0) -> list[float]:
    """Decay kernel that adds up to 1, with as many leading zeros as it is long less one."""
    h = np.exp(-np.arange(max(2, math.ceil(n_tau * tau * fs))) / (tau * fs))
    return [0.0] * (len(h) - 1) + (h / h.sum()).tolist()


def matched_filter(trace: DataFrame, keys: list[str], kernel: list[float], min_valid: float = 0.5, centred: bool = False) -> DataFrame:
    """`filtered`: sum of x[n + k] h[k], missing as 0; null where too little of the kernel meets values.

    At the onset by default (valid energy below `min_valid` is null); `centred` shifts the output by
    ceil((K - 1) / 2) and counts samples instead. The rows must be a full grid.
    """
    shift = math.ceil((len(kernel) - 1) / 2) if centred else 0
    w = _along(keys)
    at = [F.lead("value", k - shift).over(w) if k >= shift else F.lag("value", shift - k).over(w) for k in range(len(kernel))]
    total = sum((F.coalesce(x, F.lit(0.0)) * F.lit(h) for x, h in zip(at, kernel, strict=True)), F.lit(0.0))
    if centred:
        have = F.count("value").over(_along(keys, -shift, len(kernel) - 1 - shift))
        ok = have >= min_valid * len(kernel)
    else:
        ok = sum((F.when(x.isNotNull(), F.lit(h * h)).otherwise(0.0) for x, h in zip(at, kernel, strict=True)), F.lit(0.0)) >= min_valid
    return trace.withColumn("filtered", F.when(ok, total))


def exponential_filter(trace: DataFrame, keys: list[str], g: float, block: int = SIZE) -> DataFrame:
    """`filtered`: backward recursion D[t] = g D[t+1] + (1 - g) x[t], the last value scaled by g.

    Over a gap D decays, and gaps stay missing. The memory is unbounded; it is handed from block to block of `block` rows.
    """

    def respond(u: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = decayed(u, g) + z[0] * g ** np.arange(1, len(u) + 1)
        return y, y[-1:]

    present = ~F.isnan(F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))))
    last = trace.groupBy(*keys).agg(F.max(F.when(present, F.col("sample_idx"))).alias("__last"))
    share = F.when(F.col("sample_idx") == F.col("__last"), F.lit(g)).otherwise(1 - g)
    u = trace.select(*keys, "sample_idx", "value").join(last, keys).select(*keys, "sample_idx", present.alias("__ok"), F.when(present, F.col("value") * share).otherwise(0.0).alias("value"))
    run = recur(u, keys, Recursion(respond, np.array([[g]])), np.zeros(1), "filtered", backwards=True, size=block)
    return run.select(*keys, "sample_idx", F.when(F.col("__ok"), F.col("filtered")).alias("filtered"))


def decayed(u: np.ndarray, g: float, block: int = 64) -> np.ndarray:
    """y[k] = g y[k - 1] + u[k], by blocks: sums inside each, then the blocks' last values by the same rule."""
    k = np.arange(block)
    inside = np.where(k[:, None] >= k, g ** np.maximum(k[:, None] - k, 0.0), 0.0)
    if len(u) <= block:
        return inside[: len(u), : len(u)] @ u
    rows = np.append(u, np.zeros(-len(u) % block)).reshape(-1, block) @ inside.T
    ends = decayed(rows[:, -1], g**block, block)
    return (rows + np.append(0.0, ends[:-1])[:, None] * g ** (k + 1)).ravel()[: len(u)]


def fill_linear(trace: DataFrame, keys: list[str]) -> DataFrame:
    """`filled`: gaps by a straight line, edges by the nearest value, 0 where a unit has none."""
    before, after = (W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, 0) for by in (F.asc("sample_idx"), F.desc("sample_idx")))
    have = F.when(F.col("value").isNotNull(), F.struct("sample_idx", "value"))
    a, b = F.last(have, True).over(before), F.last(have, True).over(after)
    gap = b["sample_idx"] - a["sample_idx"]
    line = a["value"] + (b["value"] - a["value"]) * (F.col("sample_idx") - a["sample_idx"]) / F.when(gap != 0, gap)
    return trace.withColumn("filled", F.coalesce("value", line, a["value"], b["value"], F.lit(0.0)))


def rolling_mad(trace: DataFrame, keys: list[str], window: int, min_count: int | None = None, scale: float = 1.4826, block: int = SIZE) -> DataFrame:
    """Adds `median` and `mad`: rolling median, and rolling median of the absolute deviations from it; window // 2 samples
    lie before. Blocks of `block` rows have the rows of two windows around them, and windows move by one over an ordered list."""
    least = max(1, window // 4 if min_count is None else min_count)
    before, after = window // 2, window - 1 - window // 2

    def rolled(x: np.ndarray) -> np.ndarray:
        return pd.Series(np.append(x, np.full(after, np.nan))).rolling(window, min_periods=least).median().to_numpy()[after:]

    def solve(rows: pa.Table) -> pa.Table:
        x = rows.column("value").cast(pa.float64()).to_numpy()
        mid = rolled(x)
        spread = rolled(np.abs(x - mid)) * scale
        return rows.append_column("median", pa.array(mid, from_pandas=True)).append_column("mad", pa.array(spread, from_pandas=True))

    more = [T.StructField("median", T.DoubleType()), T.StructField("mad", T.DoubleType())]
    return with_halo(trace, keys, 2 * before, 2 * after, solve, more, block)


def rolling_mad_noise(trace: DataFrame, keys: list[str], window_s: float = 8.0, fs: float = 1.0) -> DataFrame:
    """As `rolling_mad`, with an odd window of at least three samples from seconds."""
    return rolling_mad(trace, keys, max(3, round(window_s * fs) | 1))


def rolling_std(trace: DataFrame, keys: list[str], window: int, ddof: int = 0, min_count: int = 1, smooth: str | None = None) -> DataFrame:
    """`std` over a centred window, then a median or mean over three windows if asked."""
    frame = _along(keys, -(window // 2), window - 1 - window // 2)
    spread = (F.stddev_pop if ddof == 0 else F.stddev_samp)("value").over(frame)
    out = trace.withColumn("std", F.when(F.count("value").over(frame) >= min_count, spread))
    if smooth:
        wide = _along(keys, -(3 * window // 2), 3 * window - 1 - 3 * window // 2)
        out = out.withColumn("std", F.percentile("std", F.lit(0.5)).over(wide) if smooth == "median" else F.avg("std").over(wide))
    return out


def peaks(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Local maxima inside stretches of at least three values without a gap; a plateau counts once, at its start."""
    w = _along(keys)
    have = trace.where("value is not null").withColumn("seg", F.col("sample_idx") - F.row_number().over(w))
    ws = W.partitionBy(*keys, "seg").orderBy("sample_idx")
    flat = have.withColumns({"__n": F.count(F.lit(1)).over(W.partitionBy(*keys, "seg")), "__p": F.lag("value").over(ws)}).where("__n >= 3 and (__p is null or __p <> value)")
    top = flat.withColumns({"__a": F.lag("value").over(ws), "__b": F.lead("value").over(ws)})
    return top.where("__a < value and __b < value").select(*keys, "sample_idx", F.col("value").alias("peak"))


def in_windows(trace: DataFrame, keys: list[str], window: int, step: int | None = None) -> DataFrame:
    """Each sample in every window it lies in: adds `win` and `centre`; windows start each `step` samples (chunks end
    to end by default), and those cut off by the end of a unit are left out."""
    step = step or window
    ends = trace.groupBy(*keys).agg(F.min("sample_idx").alias("__a"), F.max("sample_idx").alias("__b"))
    at = F.col("sample_idx") - F.col("__a")
    first = F.greatest(F.lit(0), F.ceil((at - (window - 1)) / step))
    last = F.least(F.floor(at / step), F.floor((F.col("__b") - F.col("__a") + 1 - window) / step))
    own = trace.join(ends, keys).withColumns({"__f": first, "__l": last}).where("__f <= __l").withColumn("win", F.explode(F.sequence("__f", "__l")))
    return own.withColumn("centre", F.col("__a") + F.col("win") * step + (window - 1) / 2).drop("__a", "__b", "__f", "__l")


def signal_to_noise(trace: DataFrame, keys: list[str], quantile: float = 0.95, window: int | None = None, step: int | None = None) -> DataFrame:
    """Noise: spread of differences over the root of two; signal: a quantile of peak heights; snr: their ratio.

    With `window` (in samples) for each window, of which `win` and `centre` tell; with `step` too, windows overlap.
    """
    if window is not None:
        trace, keys = in_windows(trace, keys, window, step), [*keys, "win", "centre"]
    diff = trace.withColumn("__d", F.col("value") - F.lag("value").over(_along(keys)))
    noise = diff.groupBy(*keys).agg((F.stddev_pop("__d") / math.sqrt(2)).alias("noise"))
    signal = peaks(trace, keys).groupBy(*keys).agg(F.percentile("peak", F.lit(quantile)).alias("signal"))
    return noise.join(signal, keys, "left").withColumn("snr", F.try_divide(F.col("signal"), F.col("noise")))


def noise_sigma(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Robust sigma: MAD of the differences / 0.6745 / sqrt 2 + 1e-12; 0 below ten differences."""
    diff = trace.withColumn("__d", F.col("value") - F.lag("value").over(_along(keys))).where("__d is not null")
    mid = diff.groupBy(*keys).agg(F.percentile("__d", F.lit(0.5)).alias("__m"))
    mad = diff.join(mid, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("__d") - F.col("__m")), F.lit(0.5)).alias("mad"), F.count(F.lit(1)).alias("n"))
    out = trace.select(*keys).distinct().join(mad, keys, "left")
    return out.select(*keys, F.when(F.coalesce("n", F.lit(0)) < 10, 0.0).otherwise(F.col("mad") / 0.6745 / math.sqrt(2) + 1e-12).alias("sigma"))


def scale_to_peak(trace: DataFrame, keys: list[str]) -> DataFrame:
    return trace.withColumn("scaled", F.try_divide(F.col("value"), F.max("value").over(W.partitionBy(*keys))))


def min_max(df: DataFrame, keys: list[str], col: str, out: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scales a column to [low, high] within groups; one distinct value goes to the middle; null stays."""
    w = W.partitionBy(*keys)
    a, b = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.when(a == b, F.when(F.col(col).isNotNull(), F.lit((low + high) / 2))).otherwise(low + (F.col(col) - a) / (b - a) * (high - low)))


def box_filter(trace: DataFrame, keys: list[str], window: int) -> DataFrame:
    """`smooth`: mean over a centred window, the edge values repeated beyond the ends."""
    before, after = window // 2, window - 1 - window // 2
    w, whole = _along(keys), W.partitionBy(*keys)
    frame = _along(keys, -before, after)
    rank, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    first, last = F.first("value").over(_along(keys, W.unboundedPreceding, W.unboundedFollowing)), F.last("value").over(_along(keys, W.unboundedPreceding, W.unboundedFollowing))
    short, long = F.greatest(F.lit(before + 1) - rank, F.lit(0)), F.greatest(rank + after - n, F.lit(0))
    return trace.withColumn("smooth", (F.sum("value").over(frame) + short * first + long * last) / window)


# --- solvers: one unit's samples at a time --------------------------------------------------------


def _per_unit(trace: DataFrame, keys: list[str], out: str, solve, given: str | None = None) -> DataFrame:
    """Applies solve(x: array with NaN) -> array to each unit's samples in order; with `given`, a column that is one
    number a unit, solve(x, number)."""
    schema = T.StructType([*trace.select(*keys, "sample_idx").schema.fields, T.StructField(out, T.DoubleType())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("sample_idx")
        x = rows.column("value").to_numpy()
        more = () if given is None else (float(rows.column(given)[0].as_py()),)
        got = np.where(np.isnan(x), np.nan, solve(x, *more)) if np.isfinite(x).any() else x
        return rows.select([*keys, "sample_idx"]).append_column(out, pa.array(got, pa.float64(), from_pandas=True))

    own = [] if given is None else [F.col(given).cast("double").alias(given)]
    return trace.select(*keys, "sample_idx", F.col("value").cast("double").alias("value"), *own).groupBy(*keys).applyInArrow(run, schema)


def _filled(x: np.ndarray) -> np.ndarray:
    i = np.arange(len(x))
    ok = np.isfinite(x)
    return np.interp(i, i[ok], x[ok])


def _median(x: np.ndarray, w: int) -> np.ndarray:
    return pd.Series(x).rolling(w, center=True, min_periods=1).median().to_numpy()


def richardson_lucy(trace: DataFrame, keys: list[str], kernel: list[float], rounds: int = 20, refills: int = 3) -> DataFrame:
    """`sharp`: non-negative deconvolution of each unit after a shift by its median less twice its first percentile.

    Gaps start from a line and are refilled from the fit `refills` times; gaps stay missing in the output.
    """
    h = np.array([k for k in kernel if k > 0])
    h = h / h.sum()

    def solve(x: np.ndarray) -> np.ndarray:
        ok, y = np.isfinite(x), _filled(x)
        shift = np.nanmedian(x) - 2 * np.nanpercentile(x, 1)
        y = np.maximum(y + shift, 1e-9)
        for _ in range(refills):
            u = np.full(len(y), y.mean())
            for _ in range(rounds):
                fit = np.convolve(u, h)[: len(y)]
                u = u * np.convolve((y / np.maximum(fit, 1e-12))[::-1], h)[: len(y)][::-1]
            y = np.where(ok, y, np.convolve(u, h)[: len(y)])
        return u - shift

    return _per_unit(trace, keys, "sharp", solve)


def _moving(x: np.ndarray, window: int, how: str) -> np.ndarray:
    """Median or mean over a centred window, cut off at the ends, of the values present."""
    right = window // 2
    rolled = pd.Series(np.append(x, np.full(right, np.nan))).rolling(window, min_periods=1)
    return getattr(rolled, how)().to_numpy()[right:]


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Piecewise cubic interpolation that keeps to the data: slopes are weighted harmonic means, 0 at turns."""
    if len(x) < 2:
        return np.full(len(at), y[0] if len(y) else np.nan)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    slope = np.zeros(len(x))
    if len(x) == 2:
        slope[:] = d[0]
    else:
        wide, narrow = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[1:] * d[:-1] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            slope[1:-1] = np.where(same, (wide + narrow) / (wide / d[:-1] + narrow / d[1:]), 0.0)
        for end, (a, b), (p, q) in ((0, (h[0], h[1]), (d[0], d[1])), (-1, (h[-1], h[-2]), (d[-1], d[-2]))):
            s = ((2 * a + b) * p - a * q) / (a + b)
            slope[end] = 0.0 if s * p <= 0 else 3 * p if p * q < 0 and abs(s) > 3 * abs(p) else s
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + slope[k] * h[k] * t * (1 - t) ** 2 + y[k + 1] * t**2 * (3 - 2 * t) + slope[k + 1] * h[k] * t**2 * (t - 1)


def slow_floor(x: np.ndarray, denoise: int, hull: int) -> np.ndarray:
    """The lower envelope of one unit: see `baseline`."""
    n = len(x)
    spacing = max(4.0, denoise / 6)
    at = np.unique(np.rint(np.linspace(0, n - 1, math.ceil(n / spacing) + 1)).astype(int))
    many = int(np.clip(math.ceil(np.clip(hull, 1, max(1, n // 4)) / spacing), 1, len(at)))
    calm = _moving(x, denoise, "median")
    lines = np.full((many, len(at)), np.nan)
    for k in range(many):
        knots = at[k::many]
        known = np.isfinite(calm[knots])
        if known.any():
            a, b = np.searchsorted(knots, at, "right") - 1, np.searchsorted(knots, at, "left")
            held = (a >= 0) & (b < len(knots))
            held[held] = known[a[held]] & known[b[held]]  # nothing is drawn over a gap or beyond the ends
            lines[k, held] = np.interp(at[held], knots[known], calm[knots[known]])
    drawn = np.isfinite(lines).sum(0)
    low = np.where(drawn > 0, np.min(np.where(np.isfinite(lines), lines, np.inf), 0), np.nan)
    sure = drawn >= math.ceil(many / 2)
    if sure.sum() > 2:
        low = np.where(sure, low, np.nan)
    wide = 2 * math.ceil(many / 2) + 1
    low = _moving(np.where(np.isfinite(low), low, _moving(low, wide, "mean")), wide, "mean")
    known = np.isfinite(low)
    return monotone_cubic(at[known].astype(float), low[known], np.arange(n, dtype=float)) if known.any() else np.full(n, np.nan)


def baseline(trace: DataFrame, keys: list[str], denoise: int = 5, hull: int = 80) -> DataFrame:
    """`f0`: a slow lower envelope, missing where the value is; windows in samples.

    A moving median is read at spaced samples. Straight lines through every m-th of these, for each of the m
    offsets, are drawn, the lowest line counts, and samples where less than half of the lines exist are in doubt and
    left to their neighbours. Two moving means and a monotone cubic through the spaced samples follow.
    """
    return _per_unit(trace, keys, "f0", lambda x: slow_floor(x, denoise, hull))


#: Seconds of the median's and the lines' windows.
DENOISE_S, HULL_S = 0.2, 4.0


def relative_change(trace: DataFrame, keys: list[str], denoise: int = 5, hull: int = 80) -> DataFrame:
    """`dff` = (F - F0) / F0, with the size of F0 at least 1e-12 and a millionth of its median size."""
    f0 = baseline(trace, keys, denoise, hull)
    floor = f0.groupBy(*keys).agg(F.greatest(F.lit(1e-12), F.percentile(F.abs("f0"), F.lit(0.5)) * 1e-6).alias("floor"))
    at = trace.join(f0, [*keys, "sample_idx"]).join(floor, keys)
    safe = F.when(F.abs("f0") < F.col("floor"), F.when(F.col("f0") < 0, -F.col("floor")).otherwise(F.col("floor"))).otherwise(F.col("f0"))
    return at.select(*keys, "sample_idx", "value", "f0", ((F.col("value") - F.col("f0")) / safe).alias("dff"))


def _biquad(cutoff: float, fs: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    k = math.tan(math.pi * cutoff / fs)
    norm = 1 + math.sqrt(2) * k + k * k
    b = np.array([1.0, -2.0, 1.0]) if high else np.array([k * k, 2 * k * k, k * k])
    return b / norm, np.array([1.0, 2 * (k * k - 1) / norm, (1 - math.sqrt(2) * k + k * k) / norm])


def _blocks(b: np.ndarray, a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block of samples and the two memories before it add to the block's output and to the memories after it."""

    def run(x: np.ndarray, z: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        out, memory = np.empty(size), np.empty((size, 2))
        for i, v in enumerate(x):
            out[i] = b[0] * v + z[0]
            z = b[1] * v - a[1] * out[i] + z[1], b[2] * v - a[2] * out[i]
            memory[i] = z
        return out, memory

    pulse, trail = run(np.eye(1, size)[0], (0.0, 0.0))
    (one, end_one), (two, end_two) = (run(np.zeros(size), z) for z in ((1.0, 0.0), (0.0, 1.0)))
    lag = np.arange(size)[:, None] - np.arange(size)
    return np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0), np.column_stack([one, two]), trail[::-1].T, np.column_stack([end_one[-1], end_two[-1]])


def _second_order(b: np.ndarray, a: np.ndarray, size: int = 256) -> Recursion:
    """The filter as a recursion over its two memories, by small blocks."""
    own, carried, after, kept = _blocks(b, a, size)
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])

    def respond(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.append(x, np.zeros(-len(x) % size)).reshape(-1, size)
        out, left = rows @ own.T, rows @ after.T
        for k in range(len(rows)):
            out[k] += carried @ z
            before, z = z, left[k] + kept @ z
        over = len(x) - (len(rows) - 1) * size
        if over < size:  # the last block is filled up: go from its start again
            z = np.linalg.matrix_power(step, over) @ before + after[:, size - over :] @ rows[-1, :over]
        return out.ravel()[: len(x)], z

    return Recursion(respond, step)


def _settled(b: np.ndarray, a: np.ndarray, high: bool) -> np.ndarray:
    """The memories under a constant input of 1."""
    return np.array([-b[0], b[2]] if high else [1 - b[0], b[2] - a[2]])


def _extension(cutoff: float, fs: float) -> int:
    return 3 * int(fs / cutoff) + 6


def zero_phase(cutoff: float, fs: float, high: bool = True):
    """A function that runs the order-2 Butterworth filter forwards and backwards over an array without gaps."""
    b, a = _biquad(cutoff, fs, high)
    through, calm = _second_order(b, a), _settled(b, a, high)
    once = lambda x: through.respond(x, calm * x[0])[0]

    def both(y: np.ndarray) -> np.ndarray:
        n = min(len(y) - 1, _extension(cutoff, fs))
        padded = np.concatenate([2 * y[0] - y[n:0:-1], y, 2 * y[-1] - y[-2 : -n - 2 : -1]])
        return once(once(padded)[::-1])[::-1][n : n + len(y)]

    return both


def butterworth(trace: DataFrame, keys: list[str], cutoff: float, fs: float, high: bool = True, block: int = SIZE) -> DataFrame:
    """`passed`: order-2 Butterworth run forwards and backwards over odd extensions of the ends.

    Gaps are bridged by a line and stay missing. The memories are handed from block to block of `block` rows.
    """
    b, a = _biquad(cutoff, fs, high)
    through, calm = _second_order(b, a), _settled(b, a, high)
    ok = ~F.isnan(F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))))
    clean = trace.select(*keys, "sample_idx", F.when(ok, F.col("value").cast("double")).alias("value"))
    filled = numbered(fill_linear(clean, keys), keys, block).select(*keys, "sample_idx", F.col("value").isNotNull().alias("__ok"), F.col("filled").alias("value"), "__rn", "__rows")
    ends = filled.groupBy(*keys).agg(F.min_by("value", "__rn").alias("__a"), F.max_by("value", "__rn").alias("__b"))
    wide = F.least(F.col("__rows") - 1, F.lit(_extension(cutoff, fs)))
    at, last = filled.join(ends, keys), F.col("__rows") - 1
    mirrored = lambda inside, pos, value: F.when(inside, F.struct(pos.alias("pos"), value.alias("value"), F.lit(False).alias("own")))
    ahead = mirrored((F.col("__rn") >= 1) & (F.col("__rn") <= wide), -F.col("__rn"), 2 * F.col("__a") - F.col("value"))
    behind = mirrored((F.col("__rn") < last) & (F.col("__rn") >= last - wide), 2 * last - F.col("__rn"), 2 * F.col("__b") - F.col("value"))
    itself = F.struct(F.col("__rn").alias("pos"), F.col("value"), F.lit(True).alias("own"))
    each = at.select(*keys, F.col("sample_idx").alias("__was"), "__ok", F.explode(F.array_compact(F.array(itself, ahead, behind))).alias("x"))
    whole = cut(each.select(*keys, F.col("x.pos").alias("sample_idx"), F.col("x.value").alias("value"), F.when(F.col("x.own"), F.col("__was")).alias("__was"), "__ok"))
    there = cut(recur(whole, keys, through, calm, "__y", size=block, on_grid=True).withColumn("value", F.col("__y")).drop("__y"))
    back = recur(there, keys, through, calm, "passed", backwards=True, size=block, on_grid=True)
    return back.where("__was is not null").select(*keys, F.col("__was").cast(trace.schema["sample_idx"].dataType).alias("sample_idx"), F.when(F.col("__ok"), F.col("passed")).alias("passed"))


def deconvolve_events(trace: DataFrame, keys: list[str], tau: float, fs: float, penalty: float = 1.0, rounds: int = 200, scale: DataFrame | None = None) -> DataFrame:
    """`amplitude`: non-negative L1 deconvolution with an exponential kernel, by accelerated proximal steps.

    The weight of the L1 term is `penalty` times the robust sigma times sqrt(2 ln n), and times each unit's own
    `scale(keys, scale)` if given.
    """
    n_h = max(2, math.ceil(8 * tau * fs))

    def solve(x: np.ndarray, own: float = 1.0) -> np.ndarray:
        ok, y = np.isfinite(x), _filled(x)
        y = y - np.nanmedian(x)
        d = np.diff(x[ok])
        sigma = np.median(np.abs(d - np.median(d))) / 0.6745 / math.sqrt(2) if len(d) else 0.0
        weight = own * penalty * sigma * math.sqrt(2 * math.log(max(10, len(y))))
        size = 1 << (len(y) + n_h).bit_length()
        fh = np.fft.rfft(np.exp(-np.arange(n_h) / (tau * fs)), size)
        step = 1 / (np.abs(fh) ** 2).max()
        a = z = np.zeros(len(y))
        t = 1.0
        for _ in range(rounds):
            r = np.where(ok, np.fft.irfft(np.fft.rfft(z, size) * fh, size)[: len(y)] - y, 0)
            g = np.fft.irfft(np.fft.rfft(r, size) * fh.conj(), size)[: len(y)]
            new = np.maximum(z - step * (g + weight), 0)
            t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
            z, a, t = new + (t - 1) / t2 * (new - a), new, t2
        return a

    if scale is None:
        return _per_unit(trace, keys, "amplitude", solve)
    return _per_unit(trace.join(scale.select(*keys, "scale"), keys), keys, "amplitude", solve, "scale")
