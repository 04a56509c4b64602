"""Signals, noise and events: queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracetide.operators import detection as de
from tracetide.operators import events as ev
from tracetide.operators import signals as sg
from tracetide.plans import standins as st
from tracetide.plans.standins import sql

U = ["unit_id"]
KERNEL = sg.decay_kernel(1.0, 1.0)


def rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def fir(spark, d):
    return rounded(sg.matched_filter(st.trace(spark, d), U, KERNEL), "filtered").select("unit_id", "sample_idx", "filtered")


def fir_centred(spark, d):
    return rounded(sg.matched_filter(st.trace(spark, d), U, KERNEL, centred=True), "filtered").select("unit_id", "sample_idx", "filtered")


def snr_events(spark, d):
    return rounded(ev.run_events(ev.with_snr(st.trace(spark, d), U, 21), U), "peak_snr", "average_snr", "integral", "peak_value")


def summary(spark, d):
    e = ev.run_events(ev.with_snr(st.trace(spark, d), U, 21), U)
    return rounded(ev.unit_summary(st.trace(spark, d), e, U, 720.0), "mean_peak", "mean_duration", "rate")


#: Weeks as seconds: slow baselines, tails of up to a quarter, decay times within each recording.
WEEKLY = de.Settings(fs=1.0, cutoff=0.02, level=2.0, merge_gap=1.0, default_tau=1.0, prominence=1.5, peak_distance=3.0, tail_start=0.0, tail_end=13.0, least_peaks=20, least_points=3, low_tau=0.2, high_tau=20.0)


def detected(spark, d):
    x = st.filled_suppliers(spark, d)
    return de.detect_events(x, ["rec", "unit_id"], WEEKLY, sg.baseline(x.withColumn("value", F.col("value") + 1), ["rec", "unit_id"], 5, 26), ["rec"])


def sums(spark, d):
    sup = st.suppliers(spark, d)
    return rounded(ev.group_sums(sup, st.supplier_groups(spark, d), sg.noise_sigma(sup, U), 1.0), "percent_active")


_taps = ", ".join(f"({k}, {h!r})" for k, h in enumerate(KERNEL))
_K = len(KERNEL)
_C = (_K - 1 + 1) // 2
MAD = """m1 AS (SELECT *, CASE WHEN count(value) OVER w >= 5 THEN quantile_cont(value, 0.5) OVER w END AS med FROM trace WINDOW w AS (PARTITION BY unit_id ORDER BY sample_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
m2 AS (SELECT *, abs(value - med) AS dev FROM m1),
mad AS (SELECT unit_id, sample_idx, value, med, CASE WHEN count(dev) OVER w >= 5 THEN quantile_cont(dev, 0.5) OVER w * 1.4826 END AS mad FROM m2 WINDOW w AS (PARTITION BY unit_id ORDER BY sample_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
snr AS (SELECT *, value / greatest(mad * 4, 1e-12) AS snr FROM mad),
rn AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY unit_id ORDER BY sample_idx) AS g FROM snr WHERE snr > 1),
evs AS (SELECT unit_id, min(sample_idx) AS start_sample, max(sample_idx) AS end_sample, count(*) AS n_samples, first(sample_idx ORDER BY snr DESC, sample_idx) AS peak_sample, max(snr) AS peak_snr, first(value ORDER BY snr DESC, sample_idx) AS peak_value, avg(snr) AS average_snr, sum(value) AS integral, count(*) * 1.0 AS event_duration FROM rn GROUP BY unit_id, g)"""
PEAKS = """sg AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY {k} ORDER BY sample_idx) AS seg FROM {t} WHERE value IS NOT NULL),
fl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {k}, seg) AS n, lag(value) OVER (PARTITION BY {k}, seg ORDER BY sample_idx) AS p FROM sg) WHERE n >= 3 AND (p IS NULL OR p <> value)),
pk AS (SELECT * FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM fl WINDOW w AS (PARTITION BY {k}, seg ORDER BY sample_idx)) WHERE a < value AND b < value)"""
DIFF = "df AS (SELECT unit_id, sample_idx, value - lag(value) OVER (PARTITION BY unit_id ORDER BY sample_idx) AS d FROM {t})"

QUERIES = {
    "matched_filter": fir,
    "matched_filter_centred": fir_centred,
    "linear_fill": lambda s, d: rounded(sg.fill_linear(st.trace(s, d), U), "filled").select("unit_id", "sample_idx", "filled"),
    "rolling_mad": lambda s, d: rounded(sg.rolling_mad(st.trace(s, d), U, 21), "mad", n=9).select("unit_id", "sample_idx", "mad"),
    "rolling_std": lambda s, d: rounded(sg.rolling_std(st.trace(s, d), U, 24, min_count=6), "std").select("unit_id", "sample_idx", "std"),
    "signal_peaks": lambda s, d: sg.peaks(st.trace(s, d), U),
    "signal_to_noise": lambda s, d: rounded(sg.signal_to_noise(st.trace(s, d), U), "noise", "signal", "snr"),
    "signal_to_noise_windows": lambda s, d: rounded(sg.signal_to_noise(st.trace(s, d), U, window=96, step=48), "noise", "signal", "snr"),
    "noise_sigma": lambda s, d: rounded(sg.noise_sigma(st.trace(s, d), U), "sigma"),
    "scaled_to_peak": lambda s, d: rounded(sg.scale_to_peak(st.trace(s, d), U), "scaled").select("unit_id", "sample_idx", "scaled"),
    "box_filter": lambda s, d: rounded(sg.box_filter(st.trace(s, d).na.fill(0.0, ["value"]), U, 5), "smooth").select("unit_id", "sample_idx", "smooth"),
    "group_min_max": lambda s, d: rounded(sg.min_max(st.suppliers(s, d).join(st.supplier_groups(s, d), "unit_id"), ["group_id"], "value", "scaled", 0.3, 1.0), "scaled").select("unit_id", "sample_idx", "scaled"),
    "run_events": snr_events,
    "peak_events": lambda s, d: ev.peak_events(st.trace(s, d), U, F.col("value") > 20, 2),
    "threshold_events": lambda s, d: rounded(ev.threshold_events(st.trace(s, d), U, 25.0, 1), "total"),
    "unit_summary": summary,
    "group_sums": sums,
    "exponential_filter": lambda s, d: rounded(sg.exponential_filter(st.trace(s, d), U, 0.8), "filtered"),
    "richardson_lucy": lambda s, d: sg.richardson_lucy(st.trace(s, d), U, sg.unit_sum_kernel(1.0, 1.0)),
    "baseline": lambda s, d: sg.baseline(st.trace(s, d), U),
    "relative_change": lambda s, d: sg.relative_change(st.trace(s, d), U),
    "butterworth": lambda s, d: sg.butterworth(st.trace(s, d), U, 0.05, 1.0),
    "deconvolved_events": lambda s, d: sg.deconvolve_events(st.trace(s, d), U, 1.0, 1.0),
    "event_decay": lambda s, d: rounded(ev.event_decay(st.trace(s, d), U, sg.noise_sigma(st.trace(s, d), U), 5, 1.0), "tail"),
    "decay_time": lambda s, d: de.decay_time(de.decay_tails(st.filled_suppliers(s, d), ["rec", "unit_id"], WEEKLY), WEEKLY, ["rec"]),
    "detected_events": lambda s, d: detected(s, d).events,
    "detected_units": lambda s, d: detected(s, d).units,
    "rate_scale": lambda s, d: rounded(ev.rate_scale(ev.unit_summary(st.trace(s, d), ev.run_events(ev.with_snr(st.trace(s, d), U, 21), U), U, 720.0)), "scale", "pop").select("unit_id", "pop", "scale"),
}

ORACLES = {
    "matched_filter": sql(f"""h(k, h) AS (VALUES {_taps}), x AS (SELECT a.unit_id, a.sample_idx, sum(coalesce(b.value, 0) * h) AS y, sum(CASE WHEN b.value IS NOT NULL THEN h * h ELSE 0 END) AS en FROM trace a CROSS JOIN h LEFT JOIN trace b ON b.unit_id = a.unit_id AND b.sample_idx = a.sample_idx + k GROUP BY 1, 2)
SELECT unit_id, sample_idx, round(CASE WHEN en >= 0.5 THEN y END, 6) AS filtered FROM x"""),
    "matched_filter_centred": sql(f"""h(k, h) AS (VALUES {_taps}), x AS (SELECT a.unit_id, a.sample_idx, sum(coalesce(b.value, 0) * h) AS y, count(b.value) AS n FROM trace a CROSS JOIN h LEFT JOIN trace b ON b.unit_id = a.unit_id AND b.sample_idx = a.sample_idx + k - {_C} GROUP BY 1, 2)
SELECT unit_id, sample_idx, round(CASE WHEN n >= 0.5 * {_K} THEN y END, 6) AS filtered FROM x"""),
    "linear_fill": sql("""n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER a AS ai, last_value(value IGNORE NULLS) OVER a AS av, first_value(CASE WHEN value IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER b AS bi, first_value(value IGNORE NULLS) OVER b AS bv FROM trace
  WINDOW a AS (PARTITION BY unit_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unit_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT unit_id, sample_idx, round(coalesce(value, av + (bv - av) * (sample_idx - ai) / nullif(bi - ai, 0), av, bv, 0), 6) AS filled FROM n"""),
    "rolling_mad": sql(MAD + " SELECT unit_id, sample_idx, round(mad, 9) AS mad FROM mad"),
    "rolling_std": sql("SELECT unit_id, sample_idx, round(CASE WHEN count(value) OVER w >= 6 THEN stddev_pop(value) OVER w END, 6) AS std FROM trace WINDOW w AS (PARTITION BY unit_id ORDER BY sample_idx ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"),
    "signal_peaks": sql(PEAKS.format(t="trace", k="unit_id") + " SELECT unit_id, sample_idx, value AS peak FROM pk"),
    "exponential_filter": sql("""RECURSIVE s AS (SELECT unit_id, sample_idx, value, row_number() OVER (PARTITION BY unit_id ORDER BY sample_idx DESC) AS k FROM trace),
r AS (SELECT unit_id, k, CAST(value * 0.8 AS DOUBLE) AS d FROM s WHERE k = 1 UNION ALL SELECT s.unit_id, s.k, CASE WHEN s.value IS NULL THEN r.d * 0.8 WHEN r.d IS NULL THEN s.value * 0.8 ELSE r.d * 0.8 + s.value * (1 - 0.8) END FROM r JOIN s ON s.unit_id = r.unit_id AND s.k = r.k + 1)
SELECT unit_id, sample_idx, round(CASE WHEN value IS NOT NULL THEN d END, 6) AS filtered FROM s JOIN r USING (unit_id, k)""").replace("WITH\n", "WITH RECURSIVE\n", 1).replace("RECURSIVE s AS", "s AS", 1),
    "signal_to_noise_windows": sql("""ends AS (SELECT unit_id, min(sample_idx) AS a, max(sample_idx) AS b FROM trace GROUP BY 1), wn AS (SELECT unit_id, a, unnest(generate_series(0, (b - a + 1 - 96) // 48)) AS win FROM ends WHERE b - a + 1 >= 96),
tw AS (SELECT t.*, win, a + win * 48 + 47.5 AS centre FROM wn JOIN trace t ON t.unit_id = wn.unit_id AND sample_idx BETWEEN a + win * 48 AND a + win * 48 + 95),
df AS (SELECT unit_id, win, centre, value - lag(value) OVER (PARTITION BY unit_id, win ORDER BY sample_idx) AS d FROM tw), """ + PEAKS.format(t="tw", k="unit_id, win") + """, no AS (SELECT unit_id, win, centre, stddev_pop(d) / sqrt(2) AS noise FROM df GROUP BY 1, 2, 3), si AS (SELECT unit_id, win, quantile_cont(value, 0.95) AS signal FROM pk GROUP BY 1, 2)
SELECT unit_id, win, centre::DOUBLE AS centre, round(noise, 6) AS noise, round(signal, 6) AS signal, round(signal / nullif(noise, 0), 6) AS snr FROM no LEFT JOIN si USING (unit_id, win)"""),
    "signal_to_noise": sql(DIFF.format(t="trace") + """, sg AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY unit_id ORDER BY sample_idx) AS seg FROM trace WHERE value IS NOT NULL),
fl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY unit_id, seg) AS n, lag(value) OVER (PARTITION BY unit_id, seg ORDER BY sample_idx) AS p FROM sg) WHERE n >= 3 AND (p IS NULL OR p <> value)),
pk AS (SELECT * FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM fl WINDOW w AS (PARTITION BY unit_id, seg ORDER BY sample_idx)) WHERE a < value AND b < value),
nz AS (SELECT unit_id, stddev_pop(d) / sqrt(2) AS noise FROM df GROUP BY 1), si AS (SELECT unit_id, quantile_cont(value, 0.95) AS signal FROM pk GROUP BY 1)
SELECT unit_id, round(noise, 6) AS noise, round(signal, 6) AS signal, round(signal / noise, 6) AS snr FROM nz LEFT JOIN si USING (unit_id)"""),
    "noise_sigma": sql(DIFF.format(t="trace") + """, md AS (SELECT unit_id, quantile_cont(d, 0.5) AS m FROM df WHERE d IS NOT NULL GROUP BY 1), s AS (SELECT unit_id, quantile_cont(abs(d - m), 0.5) AS mad, count(*) AS n FROM df JOIN md USING (unit_id) WHERE d IS NOT NULL GROUP BY 1)
SELECT unit_id, round(CASE WHEN coalesce(n, 0) < 10 THEN 0.0 ELSE mad / 0.6745 / sqrt(2) + 1e-12 END, 6)::DOUBLE AS sigma FROM (SELECT DISTINCT unit_id FROM trace) LEFT JOIN s USING (unit_id)"""),
    "scaled_to_peak": sql("SELECT unit_id, sample_idx, round(value / nullif(max(value) OVER (PARTITION BY unit_id), 0), 6) AS scaled FROM trace"),
    "box_filter": sql("""t0 AS (SELECT unit_id, sample_idx, coalesce(value, 0) AS value FROM trace), ed AS (SELECT unit_id, min(sample_idx) AS a, max(sample_idx) AS b FROM t0 GROUP BY 1)
SELECT t.unit_id, t.sample_idx, round(sum(x.value) / 5, 6) AS smooth FROM t0 t JOIN ed USING (unit_id) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) o(k) JOIN t0 x ON x.unit_id = t.unit_id AND x.sample_idx = least(greatest(t.sample_idx + k, a), b) GROUP BY 1, 2"""),
    "group_min_max": sql("SELECT unit_id, sample_idx, round(CASE WHEN a = b THEN 0.65 ELSE 0.3 + (value - a) / (b - a) * 0.7 END, 6)::DOUBLE AS scaled FROM (SELECT *, min(value) OVER (PARTITION BY group_id) AS a, max(value) OVER (PARTITION BY group_id) AS b FROM sup JOIN sgrp USING (unit_id))"),
    "run_events": sql(MAD + " SELECT unit_id, start_sample, end_sample, n_samples, peak_sample, round(peak_snr, 6) AS peak_snr, round(peak_value, 6) AS peak_value, round(average_snr, 6) AS average_snr, round(integral, 6) AS integral, event_duration::DOUBLE AS event_duration FROM evs"),
    "peak_events": sql("""g AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY unit_id ORDER BY sample_idx) AS g FROM trace WHERE value > 20)
SELECT unit_id, first(sample_idx ORDER BY value DESC, sample_idx) AS sample_idx, max(value) AS peak_value, count(*) AS run_length FROM g GROUP BY unit_id, g.g HAVING count(*) >= 2"""),
    "threshold_events": sql("""h AS (SELECT *, CASE WHEN sample_idx - lag(sample_idx) OVER (PARTITION BY unit_id ORDER BY sample_idx) > 2 THEN 1 ELSE 0 END AS nw FROM trace WHERE value > 25), g AS (SELECT *, sum(nw) OVER (PARTITION BY unit_id ORDER BY sample_idx) AS g FROM h)
SELECT unit_id, min(sample_idx) AS start_sample, max(value) AS peak_value, round(sum(value), 6) AS total, max(sample_idx) - min(sample_idx) + 1 AS width FROM g GROUP BY unit_id, g.g"""),
    "unit_summary": sql(MAD + """, s AS (SELECT unit_id, count(*) AS n_events, avg(peak_value) AS mp, avg(event_duration) AS md FROM evs GROUP BY 1)
SELECT unit_id, coalesce(n_events, 0) AS n_events, round(coalesce(mp, 0), 6)::DOUBLE AS mean_peak, round(coalesce(md, 0), 6)::DOUBLE AS mean_duration, round(coalesce(n_events, 0) / 720.0, 6)::DOUBLE AS rate FROM (SELECT DISTINCT unit_id FROM trace) LEFT JOIN s USING (unit_id)"""),
    "group_sums": sql(DIFF.format(t="sup") + """, md AS (SELECT unit_id, quantile_cont(d, 0.5) AS m FROM df WHERE d IS NOT NULL GROUP BY 1), s AS (SELECT unit_id, CASE WHEN count(*) < 10 THEN 0 ELSE quantile_cont(abs(d - m), 0.5) / 0.6745 / sqrt(2) + 1e-12 END AS sigma FROM df JOIN md USING (unit_id) WHERE d IS NOT NULL GROUP BY 1),
big AS (SELECT group_id FROM sgrp GROUP BY 1 HAVING count(DISTINCT unit_id) >= 2)
SELECT group_id, sample_idx, sum(value) AS total, round(avg(CASE WHEN value > 1.0 * sigma THEN 1.0 ELSE 0.0 END) * 100, 6)::DOUBLE AS percent_active FROM sup JOIN sgrp USING (unit_id) JOIN big USING (group_id) JOIN s USING (unit_id) GROUP BY 1, 2"""),
}
