"""Events from traces: runs above a level, peaks of runs, merged threshold crossings, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.operators import signals as sg
from tracetide.operators.intervals import runs, samples_in_states


def with_snr(trace: DataFrame, keys: list[str], window: int, factor: float = 4.0) -> DataFrame:
    """`snr` = value / max(factor * rolling MAD noise, 1e-12)."""
    noisy = sg.rolling_mad(trace, keys, window)
    return noisy.withColumn("snr", F.col("value") / F.greatest(F.col("mad") * factor, F.lit(1e-12)))


def run_events(df: DataFrame, keys: list[str], level: float = 1.0, fs: float = 1.0) -> DataFrame:
    """One row for each run of snr > level: bounds, length, first largest snr, means and sum of the value."""
    at = runs(df.where(F.col("snr").isNotNull()), keys, F.col("snr") > level)
    best = F.max(F.struct("snr", (-F.col("sample_idx")).alias("i"), "value"))
    out = at.groupBy(*keys, "run").agg(F.min("sample_idx").alias("start_sample"), F.max("sample_idx").alias("end_sample"), F.count(F.lit(1)).alias("n_samples"), best.alias("b"), F.avg("snr").alias("average_snr"), F.sum("value").alias("integral"))
    return out.select(*keys, "start_sample", "end_sample", "n_samples", (-F.col("b.i")).alias("peak_sample"), F.col("b.snr").alias("peak_snr"), F.col("b.value").alias("peak_value"), "average_snr", "integral", (F.col("n_samples") / fs).alias("event_duration"))


def peak_events(df: DataFrame, keys: list[str], flag: Column, min_run: int = 1) -> DataFrame:
    """Each run of the flag as one event at its largest value, the earliest of equal ones, nulls last."""
    w = W.partitionBy(*keys, "run")
    at = runs(df, keys, flag).withColumns({"run_length": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy(F.col("value").desc_nulls_last(), "sample_idx"))})
    return at.where((F.col("r") == 1) & (F.col("run_length") >= min_run)).select(*keys, "sample_idx", F.col("value").alias("peak_value"), "run_length")


def threshold_events(df: DataFrame, keys: list[str], level: float, merge_gap: int = 0) -> DataFrame:
    """Samples above the level, those at most merge_gap + 1 apart together: peak, sum and width."""
    w = W.partitionBy(*keys).orderBy("sample_idx")
    hit = df.where(F.col("value") > level).withColumn("n", F.sum(F.coalesce(F.col("sample_idx") - F.lag("sample_idx").over(w) > merge_gap + 1, F.lit(False)).cast("int")).over(w))
    return hit.groupBy(*keys, "n").agg(F.min("sample_idx").alias("start_sample"), F.max("value").alias("peak_value"), F.sum("value").alias("total"), (F.max("sample_idx") - F.min("sample_idx") + 1).alias("width")).drop("n")


def unit_summary(units: DataFrame, events: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Count, rate and means of every unit; silent units have zeros."""
    s = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg("peak_value").alias("mean_peak"), F.avg("event_duration").alias("mean_duration"))
    return units.select(*keys).distinct().join(s, keys, "left").na.fill(0, ["n_events", "mean_peak", "mean_duration"]).withColumn("rate", F.col("n_events") / seconds)


def rate_by_state(valid: DataFrame, events: DataFrame, states: DataFrame, units: DataFrame, keys: list[str], dt: float = 1.0) -> DataFrame:
    """`keys, state, valid_time, n_events, rate` for every unit and state: events at valid samples of a state over the time
    that these samples cover; pairs of a unit and a state without any have zeros and a null rate.

    valid: `keys, sample_idx` of the samples that count; events: `keys, sample_idx, n`; samples in several intervals don't
    count. One join gives both numbers.
    """
    inside = samples_in_states(valid.select(*keys, "sample_idx"), states).join(events.select(*keys, "sample_idx", "n"), [*keys, "sample_idx"], "left")
    found = inside.groupBy(*keys, "state").agg((F.count(F.lit(1)) * dt).alias("valid_time"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_events"))
    every = units.select(*keys).distinct().join(states.select("state").distinct())
    out = every.join(found, [*keys, "state"], "left").na.fill(0, ["valid_time", "n_events"])
    return out.withColumn("rate", F.try_divide(F.col("n_events").cast("double"), F.col("valid_time")))


def group_sums(trace: DataFrame, groups: DataFrame, noise: DataFrame, level: float = 5.0, min_units: int = 2) -> DataFrame:
    """Per group and sample: summed value and percent of units above level x noise, for groups of enough units."""
    big = groups.groupBy("group_id").agg(F.countDistinct("unit_id").alias("n")).where(F.col("n") >= min_units).select("group_id")
    at = trace.where("value is not null").join(groups.join(big, "group_id").select("unit_id", "group_id"), "unit_id").join(noise, "unit_id")
    return at.groupBy("group_id", "sample_idx").agg(F.sum("value").alias("total"), (F.avg((F.col("value") > level * F.col("sigma")).cast("int")) * 100).alias("percent_active"))


def event_decay(trace: DataFrame, keys: list[str], sigma: DataFrame, tail: int = 5, height: float = 6.0) -> DataFrame:
    """Mean normalised tail after peaks above median + height x sigma (`detection.decay_time` fits a decay to such tails)."""
    mid = trace.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("m"))
    pk = sg.peaks(trace, keys).join(mid, keys).join(sigma, keys).where(F.col("peak") > F.col("m") + height * F.col("sigma"))
    after = pk.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(tail)))).withColumn("at", F.col("sample_idx") + F.col("lag")).drop("sample_idx")
    got = after.join(trace.withColumnRenamed("sample_idx", "at"), [*keys, "at"]).where("value is not null")
    share = (F.col("value") - F.col("m")) / (F.col("peak") - F.col("m"))
    return got.groupBy("lag").agg(F.avg(share).alias("tail"), F.count(F.lit(1)).alias("n"))


def rate_scale(summary: DataFrame, beta: float = 0.5, low: float = 0.5, high: float = 2.0, eps: float = 1e-9) -> DataFrame:
    """Threshold scale of each unit: (geometric mean rate / own rate) ** beta, clipped."""
    mean = summary.agg(F.exp(F.avg(F.ln(F.col("rate") + eps))).alias("pop"))
    return summary.join(F.broadcast(mean)).withColumn("scale", F.greatest(F.lit(low), F.least(F.lit(high), F.pow(F.col("pop") / (F.col("rate") + eps), beta))))


def deconvolved_events(trace: DataFrame, keys: list[str], tau: float, fs: float, level: float = 3.0, merge_gap_s: float = 0.01, second_pass: bool = True) -> DataFrame:
    """Events of the deconvolved trace above `level` sigmas, with the unit's sigma and penalty scale.

    The first pass gives every unit's rate of events; in the second, units that fire more than the geometric mean get
    a weaker penalty and quiet ones a stronger one (`rate_scale`). Rates count the trace's whole time.
    """
    sigma = sg.noise_sigma(trace, keys)
    span = trace.groupBy(*keys).agg(((F.max("sample_idx") - F.min("sample_idx") + 1) / fs).alias("__s"))

    def found(scale: DataFrame | None) -> DataFrame:
        got = sg.deconvolve_events(trace, keys, tau, fs, scale=scale).join(sigma, keys)
        ratio = got.withColumn("value", F.try_divide(F.col("amplitude"), F.col("sigma"))).select(*keys, "sample_idx", "value")
        return threshold_events(ratio, keys, level, max(0, round(merge_gap_s * fs)))

    scale = span.select(*keys, F.lit(1.0).alias("scale"))
    if second_pass:
        n = found(None).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        rates = span.join(n, keys, "left").select(*keys, (F.coalesce("__n", F.lit(0)) / F.greatest("__s", F.lit(1e-12))).alias("rate"))
        scale = rate_scale(rates, eps=1e-6).select(*keys, "scale")
    return found(scale if second_pass else None).join(sigma, keys).join(scale, keys)
