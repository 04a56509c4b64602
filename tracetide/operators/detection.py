"""Events by non-negative deconvolution: decay time from the traces, baseline and F0 taken out, penalties by rate.

A unit's trace is solved as a whole in one group, since the penalty, the noise and the baseline are the unit's; only
events, tails and sums leave it. What units of a recording share, the decay time and the typical rate, is aggregated in
Spark between the passes.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetide.operators.blocks import cut
from tracetide.operators.signals import _filled, zero_phase
from tracetide.sources.detections import due, put


@dataclass(frozen=True)
class Settings:
    """What a detection rests on; `tau` None has the decay time estimated from the traces, in seconds like all times."""

    fs: float
    tau: float | None = None
    cutoff: float = 0.05  # Hz of the low-pass that is the baseline; 0 leaves the trace's median as baseline
    divide: bool = True  # by F0, where F0 is given
    kernel_floor: float = 1e-3
    penalty: float = 1.0
    rounds: int = 80
    tolerance: float = 1e-4
    level: float = 2.0  # sigmas an amplitude must exceed
    merge_gap: float = 0.01
    second_pass: bool = True
    beta: float = 0.6
    low_scale: float = 0.5
    high_scale: float = 2.0
    default_tau: float = 0.1
    prominence: float = 6.0  # sigmas of peaks whose tails are fitted
    peak_distance: float = 0.2
    tail_start: float = 0.01
    tail_end: float = 0.25
    tail_floor: float = 0.15
    least_peaks: int = 50
    least_points: int = 10
    low_tau: float = 0.01
    high_tau: float = 1.0

    def __post_init__(self):
        if self.fs <= 0 or (self.tau is not None and self.tau <= 0):
            raise ValueError("sampling rate and decay time must be positive")

    @property
    def mark(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


class Detection(NamedTuple):
    events: DataFrame
    units: DataFrame
    decay: DataFrame


# --- one unit ------------------------------------------------------------------------------------


def robust_sigma(x: np.ndarray) -> float:
    """MAD of the differences of neighbours present, as a standard deviation of the samples; 0 below ten."""
    d = np.diff(x)
    d = d[np.isfinite(d)]
    return float(np.median(np.abs(d - np.median(d))) / 0.6744897501960817 / math.sqrt(2) + 1e-12) if len(d) >= 10 else 0.0


def robust_slope(x: np.ndarray, y: np.ndarray, rounds: int = 10) -> float:
    """Slope of y on x through the origin, samples with large residuals weighing less (Huber), so that events don't count."""
    if not (x**2).sum() > 0:
        return 0.0
    w, slope = np.ones(len(x)), 0.0
    for _ in range(rounds):
        slope = float((w * x * y).sum() / (w * x * x).sum())
        r = np.abs(y - slope * x - np.median(y - slope * x))
        cut = 1.345 * np.median(r) / 0.6744897501960817
        w = np.where(r <= cut, 1.0, cut / np.maximum(r, 1e-300)) if cut > 0 else w
    return slope


def cleaned(x: np.ndarray, f0: np.ndarray | None, s: Settings) -> np.ndarray:
    """The trace over F0, less its slow baseline and less what follows F0's own faster changes; gaps stay.

    Gaps are bridged by a line for the low-pass alone. Samples without a positive F0 are missing.
    """
    y = x.copy()
    if f0 is not None:
        f0 = np.where(f0 > 0, f0, np.nan)
        y = y / f0 if s.divide else np.where(np.isfinite(f0), y, np.nan)
    ok = np.isfinite(y)
    if not ok.any():
        return np.full(len(x), np.nan)
    low = zero_phase(s.cutoff, s.fs, high=False) if s.cutoff > 0 and len(y) > 2 else None
    flat = lambda v: v - (low(v) if low else np.median(v[ok]))
    y = flat(_filled(y))
    if f0 is not None:
        fast = flat(_filled(f0))
        y = y - robust_slope(fast[ok], y[ok]) * fast
    return np.where(ok, y, np.nan)


def deconvolve(y: np.ndarray, tau: float, weight: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(amplitudes, fit): least squares with an L1 penalty and amplitudes of 0 or more, by accelerated proximal steps,
    until the objective hardly changes. Missing samples have no residual."""
    ok, y = np.isfinite(y), np.nan_to_num(y)
    kernel = np.exp(-np.arange(math.ceil(-tau * math.log(s.kernel_floor) * s.fs) + 1) / (tau * s.fs))
    size = 1 << (len(y) + len(kernel)).bit_length()
    response = np.fft.rfft(kernel, size)
    fit = lambda a: np.fft.irfft(np.fft.rfft(a, size) * response, size)[: len(y)]
    back = lambda r: np.fft.irfft(np.fft.rfft(r, size) * response.conj(), size)[: len(y)]
    step = 1 / (float((np.abs(response) ** 2).max()) + 1e-12)
    a = z = np.zeros(len(y))
    t, before = 1.0, math.inf
    for k in range(s.rounds):
        new = np.maximum(z - step * (back(np.where(ok, fit(z) - y, 0.0)) + weight), 0.0)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, a, t = new + (t - 1) / later * (new - a), new, later
        if k % 5 == 0:
            r = np.where(ok, fit(a) - y, 0.0)
            now = 0.5 * float(r @ r) + weight * float(a.sum())
            if math.isfinite(before) and abs(before - now) / (before + 1e-12) < s.tolerance:
                break
            before = now
    return a, fit(a)


def turning_points(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(peaks, their prominence): local maxima, a plateau at its start, and how far each stands above the higher of the
    lowest points on both ways to something higher, or to the end. One stack of falling peaks, so linear in the samples."""
    at = np.flatnonzero(np.append(True, np.diff(y) != 0))
    v = y[at]
    peak = at[1:-1][(v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])]
    if not len(peak):
        return peak, np.zeros(0)
    between = np.minimum.reduceat(y, np.append(0, peak))  # the lowest before the first peak, between two, after the last

    def lowest(heights: list[float], gaps: list[float]) -> list[float]:
        falling, out = [], []
        for h, low in zip(heights, gaps, strict=True):
            while falling and falling[-1][0] <= h:
                low = min(low, falling.pop()[1])
            falling.append((h, low))
            out.append(low)
        return out

    height = y[peak].tolist()
    left = lowest(height, between[:-1].tolist())
    right = lowest(height[::-1], between[:0:-1].tolist())[::-1]
    return peak, y[peak] - np.maximum(left, right)


def apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks stay if none may lie nearer than `distance` to a higher one that stays."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(-height, kind="stable"):
        if keep[k]:
            a, b = np.searchsorted(at, (at[k] - distance + 1, at[k] + distance))
            keep[a:b] = False
            keep[k] = True
    return keep


def tails(y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(median share of the peak left at each lag, peaks behind it) over a unit's prominent peaks. A tail ends where the
    next such peak begins to rise, so that later events don't make it longer."""
    n, sigma = round(s.tail_end * s.fs), robust_sigma(y)
    if n < 2 or not sigma > 0:
        return np.zeros(0), np.zeros(0, np.int64)
    y = _filled(y)
    y = y - np.median(y)  # from the level between events, which lies below the baseline that events raise
    at, stands = turning_points(y)
    high = (stands > s.prominence * sigma) & (y[at] > s.prominence * sigma)
    every = at[high]
    at = every[apart(every, y[every], max(1, round(s.peak_distance * s.fs)))]
    at = at[(at >= 1) & (at + n < len(y))]
    if not len(at):
        return np.zeros(0), np.zeros(0, np.int64)
    share = np.maximum(y[at[:, None] + np.arange(n)] / y[at, None], 0.0)
    later = np.append(every, len(y) + n)[np.searchsorted(every, at, "right")]
    rise = np.array([p + 1 + int(np.argmin(y[p + 1 : q])) if q < len(y) and q > p + 1 else q for p, q in zip(at, later, strict=True)])
    share[at[:, None] + np.arange(n) > rise[:, None]] = np.nan
    count = np.isfinite(share).sum(0)
    n = int((count > 0).sum())
    return np.nanmedian(share[:, :n], axis=0), count[:n]


def events_of(a: np.ndarray, least: float, gap: int) -> list[tuple[int, float, float, int]]:
    """(peak sample, its amplitude, sum, width) of samples above `least`, those at most `gap` + 1 apart together."""
    at = np.flatnonzero(a > least)
    if not len(at):
        return []
    groups = np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1)
    out = []
    for g in groups:
        own = a[g[0] : g[-1] + 1]
        out.append((int(g[0] + own.argmax()), float(own.max()), float(own.sum()), len(own)))
    return out


# --- all units -----------------------------------------------------------------------------------


def _by_unit(df: DataFrame, keys: list[str], more: list[T.StructField], job: Callable[[pa.Table], dict[str, list]], *own: str) -> DataFrame:
    """job(rows of a unit in order) -> columns, for each unit; `own` are further columns the job reads."""
    names = [f.name for f in more]
    schema = T.StructType([*(df.schema[k] for k in keys), *more])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = job(rows.sort_by("sample_idx"))
        n = len(found[names[0]])
        columns = {k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table(columns | {f.name: pa.array(found[f.name], rows_type(f)) for f in more})

    def rows_type(f: T.StructField) -> pa.DataType:
        return pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64()

    return df.select(*keys, "sample_idx", *own).groupBy(*keys).applyInArrow(run, schema)


def _numbers(*names: str, longs: tuple[str, ...] = ()) -> list[T.StructField]:
    return [T.StructField(n, T.LongType() if n in longs else T.DoubleType()) for n in names]


def _array(rows: pa.Table, name: str) -> np.ndarray | None:
    return rows.column(name).cast(pa.float64()).to_numpy() if name in rows.column_names else None


def _with_f0(trace: DataFrame, keys: list[str], f0: DataFrame | None) -> tuple[DataFrame, list[str]]:
    if f0 is None:
        return trace.select(*keys, "sample_idx", "value"), ["value"]
    return trace.select(*keys, "sample_idx", "value").join(f0.select(*keys, "sample_idx", "f0"), [*keys, "sample_idx"], "left"), ["value", "f0"]


def clean_traces(trace: DataFrame, keys: list[str], settings: Settings, f0: DataFrame | None = None) -> DataFrame:
    """`(keys, sample_idx, clean)`: see `cleaned`. `f0(keys, sample_idx, f0)` joins by sample."""

    def job(rows: pa.Table) -> dict[str, list]:
        y = cleaned(_array(rows, "value"), _array(rows, "f0"), settings)
        return {"sample_idx": rows.column("sample_idx").to_pylist(), "clean": [None if math.isnan(v) else v for v in y.tolist()]}

    df, own = _with_f0(trace, keys, f0)
    return _by_unit(df, keys, _numbers("sample_idx", "clean", longs=("sample_idx",)), job, *own)


def decay_tails(trace: DataFrame, keys: list[str], settings: Settings, f0: DataFrame | None = None) -> DataFrame:
    """`(keys, lag, tail, n)`: each unit's median tail after prominent peaks, in shares of the peak, by lag in samples."""

    return _tails_of(clean_traces(trace, keys, settings, f0), ["clean"], keys, settings)


def _tails_of(df: DataFrame, own: list[str], keys: list[str], settings: Settings) -> DataFrame:
    def job(rows: pa.Table) -> dict[str, list]:
        tail, n = tails(_array(rows, "clean"), settings)
        return {"lag": list(range(len(tail))), "tail": tail.tolist(), "n": n.tolist()}

    return _by_unit(df, keys, _numbers("lag", "tail", "n", longs=("lag", "n")), job, *own)


def decay_time(tails: DataFrame, settings: Settings, within: list[str] | None = None) -> DataFrame:
    """`(within, n_peaks, n_points, slope, tau)`: a line through the logarithm of the tail pooled over units, weighted by
    peaks, from `tail_start` to where it first falls below `tail_floor`. Too few peaks or points, or no decay, give the
    default with a null slope."""
    by, s = within or [], settings
    pooled = tails.groupBy(*by, "lag").agg((F.sum(F.col("tail") * F.col("n")) / F.sum("n")).alias("tail"), F.sum("n").alias("n"))
    late = F.col("lag") >= round(s.tail_start * s.fs)
    end = pooled.groupBy(*by).agg(F.min(F.when(late & (F.col("tail") <= s.tail_floor), F.col("lag"))).alias("end"), F.max("n").alias("n_peaks"))
    at = pooled.join(end, by) if by else pooled.join(F.broadcast(end))
    used = F.when(late & (F.col("end").isNull() | (F.col("lag") < F.col("end"))) & (F.col("tail") > s.tail_floor), F.col("lag") / s.fs)
    fit = at.groupBy(*by).agg(F.max("n_peaks").alias("n_peaks"), F.count(used).alias("n_points"), F.regr_slope(F.when(used.isNotNull(), F.ln("tail")), used).alias("slope"))
    good = (F.col("n_peaks") >= s.least_peaks) & (F.col("n_points") >= s.least_points) & (F.col("slope") < 0)
    slope = F.when(good, F.col("slope"))
    tau = F.when(good, F.greatest(F.lit(s.low_tau), F.least(F.lit(s.high_tau), -1 / F.col("slope")))).otherwise(s.default_tau)
    return fit.select(*by, F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), F.coalesce("n_points", F.lit(0)).alias("n_points"), slope.alias("slope"), tau.alias("tau"))


def detect_events(trace: DataFrame, keys: list[str], settings: Settings, f0: DataFrame | None = None, within: list[str] | None = None) -> Detection:
    """Events, units and decay times of all units of `trace(keys, sample_idx, value)`; gaps are null values.

    `within` are the keys that name a recording: its units share the decay time and the typical rate (all units do, if
    there are none). The first pass gives each unit's rate; in the second a unit's penalty is scaled by (geometric mean
    rate / own rate) ** beta within bounds, so that busy units lose fewer events. Units without events are in `units`.

    `events`: keys, peak_idx, time, amp_peak, amp_sum, width, snr, amp_f (amp_peak times the unit's median F0).
    `units`: keys, sigma, f0_median, alpha, scale, n_events, rate, mean_peak, mean_snr. `decay`: within, tau and its fit.
    """
    s, by = settings, within or []
    df, own = _with_f0(trace, keys, f0)

    def clean(rows: pa.Table) -> dict[str, list]:
        y = cleaned(_array(rows, "value"), _array(rows, "f0"), s)
        more = {"f0": rows.column("f0").to_pylist()} if "f0" in rows.column_names else {}
        return {"sample_idx": rows.column("sample_idx").to_pylist(), "clean": [None if math.isnan(v) else v for v in y.tolist()]} | more

    own_names = ["clean", *own[1:]]
    df, own = cut(_by_unit(df, keys, _numbers("sample_idx", *own_names, longs=("sample_idx",)), clean, *own)), own_names  # three passes read it
    if s.tau is None:
        decay = cut(decay_time(_tails_of(df, own, keys, s), s, by))
        named = df.select(*by).distinct() if by else None  # a recording without any peak has the default
        decay = named.join(decay, by, "left").na.fill({"n_peaks": 0, "n_points": 0, "tau": s.default_tau}) if by else decay
    else:
        lone = df.select(*by).distinct() if by else df.sparkSession.range(1)
        decay = lone.select(*by, F.lit(0).cast("long").alias("n_peaks"), F.lit(0).cast("long").alias("n_points"), F.lit(None).cast("double").alias("slope"), F.lit(float(s.tau)).alias("tau"))
    with_tau = lambda d: d.join(decay.select(*by, "tau"), by) if by else d.join(F.broadcast(decay.select("tau")))
    gap = max(0, round(s.merge_gap * s.fs))

    def solved(rows: pa.Table) -> tuple[float, float, list]:
        y = _array(rows, "clean")
        sigma, scale = robust_sigma(y), float(rows.column("scale")[0].as_py()) if "scale" in rows.column_names else 1.0
        alpha = scale * s.penalty * sigma * math.sqrt(2 * math.log(max(10, len(y))))
        if not np.isfinite(y).any():
            return sigma, alpha, []
        a, _ = deconvolve(y, float(rows.column("tau")[0].as_py()), alpha, s)
        return sigma, alpha, events_of(a, s.level * sigma, gap)

    def count(rows: pa.Table) -> dict[str, list]:
        sigma, alpha, found = solved(rows)
        f = _array(rows, "f0")
        f = f[f > 0] if f is not None else np.zeros(0)
        first, last = rows.column("sample_idx")[0].as_py(), rows.column("sample_idx")[rows.num_rows - 1].as_py()
        return {"sigma": [sigma], "f0_median": [float(np.median(f)) if len(f) else None], "alpha": [alpha], "seconds": [(last - first + 1) / s.fs], "n_first": [len(found)]}

    def list_events(rows: pa.Table) -> dict[str, list]:
        sigma, _, found = solved(rows)
        idx, gone = rows.column("sample_idx").to_pylist(), 1e-12
        return {"peak_idx": [idx[p] for p, *_ in found], "time": [idx[p] / s.fs for p, *_ in found], "amp_peak": [x for _, x, _, _ in found], "amp_sum": [x for _, _, x, _ in found], "width": [w / s.fs for *_, w in found], "snr": [x / (sigma + gone) for _, x, _, _ in found]}

    units = cut(_by_unit(with_tau(df), keys, _numbers("sigma", "f0_median", "alpha", "seconds", "n_first", longs=("n_first",)), count, *own, "tau"))
    if s.second_pass:
        rate = F.col("n_first") / F.greatest("seconds", F.lit(1e-12)) + 1e-6
        typical = units.groupBy(*by).agg(F.exp(F.avg(F.ln(rate))).alias("typical"))
        units = units.join(typical, by) if by else units.join(F.broadcast(typical))
        units = units.withColumn("scale", F.greatest(F.lit(s.low_scale), F.least(F.lit(s.high_scale), F.pow(F.col("typical") / rate, s.beta))))
    else:
        units = units.withColumn("scale", F.lit(1.0))
    units = units.select(*keys, "sigma", "f0_median", (F.col("alpha") * F.col("scale")).alias("alpha"), "scale", "seconds")
    found = _by_unit(with_tau(df).join(units.select(*keys, "scale"), keys), keys, _numbers("peak_idx", "time", "amp_peak", "amp_sum", "width", "snr", longs=("peak_idx",)), list_events, *own, "tau", "scale")
    events = found.join(units.select(*keys, "f0_median"), keys).withColumn("amp_f", F.col("amp_peak") * F.col("f0_median")).drop("f0_median")
    sums = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg("amp_peak").alias("mean_peak"), F.avg("snr").alias("mean_snr"))
    summary = units.join(sums, keys, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0))).withColumn("rate", F.col("n_events") / F.greatest("seconds", F.lit(1e-12)))
    return Detection(events, summary.select(*keys, "sigma", "f0_median", "alpha", "scale", "n_events", "rate", "mean_peak", "mean_snr"), decay)


def fitted_traces(trace: DataFrame, keys: list[str], settings: Settings, detection: Detection, f0: DataFrame | None = None, within: list[str] | None = None) -> DataFrame:
    """`(keys, sample_idx, clean, amplitude, fit)` with the penalties and decay times of a detection."""
    by = within or []
    df, own = _with_f0(trace, keys, f0)
    tau = detection.decay.select(*by, "tau")
    df = (df.join(tau, by) if by else df.join(F.broadcast(tau))).join(detection.units.select(*keys, "alpha"), keys)

    def job(rows: pa.Table) -> dict[str, list]:
        y = cleaned(_array(rows, "value"), _array(rows, "f0"), settings)
        known = np.isfinite(y).any()
        a, fit = deconvolve(y, float(rows.column("tau")[0].as_py()), float(rows.column("alpha")[0].as_py()), settings) if known else (y * 0, y * 0)
        whole = lambda v: [None if math.isnan(x) else x for x in v.tolist()]
        return {"sample_idx": rows.column("sample_idx").to_pylist(), "clean": whole(y), "amplitude": whole(a), "fit": whole(fit)}

    return _by_unit(df, keys, _numbers("sample_idx", "clean", "amplitude", "fit", longs=("sample_idx",)), job, *own, "tau", "alpha")


def refresh_detections(spark: SparkSession, trace: DataFrame, out: str, recording: str, keys: list[str], settings: Settings, versions: DataFrame, f0: DataFrame | None = None) -> DataFrame:
    """Detects the events of recordings whose stored outputs are absent, of another source version or of other
    settings; returns `(recording, source_version, settings)` of what was built.

    `versions(recording, source_version)` lists what should be there. `events`, `units` and `decay` are written under
    `out`, a partition for each recording, replaced only for those built. The marker that makes them count is written
    last, so that a run that ends early is done again.
    """
    todo = due(spark, f"{out}/marks", versions, recording, settings.mark)
    own = lambda df: df.join(F.broadcast(todo.select(recording)), recording, "left_semi")
    done = detect_events(own(trace), keys, settings, own(f0) if f0 is not None else None, [recording])
    put(done._asdict().items(), todo, out, recording)
    return todo
