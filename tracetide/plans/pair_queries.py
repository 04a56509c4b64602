"""Pairs, dynamics, ensembles and statistics: queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracetide.operators import dynamics as dy
from tracetide.operators import intervals as iv
from tracetide.operators import pairs as pr
from tracetide.operators import stats as ss
from tracetide.plans import standins as st
from tracetide.plans.signal_queries import rounded
from tracetide.plans.interval_queries import SWEPT
from tracetide.plans.standins import sql

BLOCK = 26


def weekly(spark, d):
    """Suppliers by week in bouts of half a year, alternately called A and B."""
    b = F.floor(F.col("sample_idx") / BLOCK)
    return st.suppliers(spark, d).withColumns({"bout_idx": b, "state": F.when(b % 2 == 0, "A").otherwise("B")})


def by_bout(spark, d):
    return pr.pearson(weekly(spark, d), ["rec", "bout_idx", "state"], st.shipped_tasks(spark, d))


def fisher(spark, d):
    return pr.fisher_mean(by_bout(spark, d), ["state"])


def classified(spark, d):
    return pr.classify(fisher(spark, d), st.supplier_groups(spark, d))


def difference(spark, d):
    return pr.state_difference(fisher(spark, d), "A", "B")


def grouped_difference(spark, d):
    g = st.supplier_groups(spark, d)
    return difference(spark, d).join(g.select(F.col("unit_id").alias("i"), "group_id", "group_type"), "i")


def user_trace(spark, d):
    return st.trace(spark, d).withColumn("unit_pos", F.col("unit_id"))


def windows(spark, d):
    w = dy.sliding_windows(st.states(spark, d), 12, 6).withColumnRenamed("start_time", "b_start")
    return rounded(dy.window_correlation(user_trace(spark, d), w, ["b_start", "w"], 0.5), "valid_share", "mean_r", "share_above")


def drift(spark, d):
    return rounded(dy.head_tail(weekly(spark, d), 5, ["rec", "bout_idx"]), "head", "tail", "delta_r", "delta_z").select("rec", "bout_idx", "i", "j", "head", "tail", "delta_r", "delta_z")


def loadings(spark, d):
    t = st.filled_suppliers(spark, d).withColumn("bout_idx", F.floor(F.col("sample_idx") / BLOCK))
    return dy.principal_components(t.select("rec", "bout_idx", "sample_idx", "unit_pos", "value"), ["rec", "bout_idx"], 3)


def matrix(spark, d):
    """A matrix a recording, by the units' places in it."""
    place = lambda c: F.col(c) % st.PER_RECORDING
    r = pr.pearson(st.suppliers(spark, d), ["rec"]).withColumns({"i": place("i"), "j": place("j")})
    return rounded(pr.to_matrix(r, "r", list(range(st.PER_RECORDING)), keys=["rec"]), *[f"u{k}" for k in range(st.PER_RECORDING)])


def stability(spark, d):
    z = by_bout(spark, d).select("rec", "bout_idx", F.concat_ws("-", "i", "j").alias("pair"), F.round(pr.to_z(F.col("r")), 9).alias("z"))
    return rounded(dy.rank_stability(z, [1, 2], keys=["rec"]), "rho")


def metrics(spark, d):
    seg = iv.atomic_segments(st.recording_states(spark, d, 0), st.recording_states(spark, d, 1), ["rec"])
    return rounded(ss.label_metrics(ss.confusion(seg, "a_state", "b_state", F.col("duration"))), "accuracy", "precision", "recall", "f1")


def transition_windows(spark, d):
    """Windows of 8 hours around every change from clicks to views of every recording, bouts of 12 hours at least."""
    t = dy.onsets(st.recording_states(spark, d, 0), "view", "click", keys=["rec"], min_before=12, min_onset=12)
    return rounded(dy.transition_windows(t, 8, 3, 20, 16).select("rec", "t0", "phase", "k", "w_start", "w_end", F.col("t_rel").cast("double").alias("t_rel")), "w_start")


def onset_windows(spark, d):
    t = dy.onsets(st.states(spark, d), "view", "click")
    return dy.onset_windows(t, 4, 2, 12).select("t0", "k", F.col("w_start").cast("double").alias("w_start"), F.col("t_rel").cast("double").alias("t_rel"))


PAIRS = """wk AS (SELECT *, sample_idx // 26 AS bout_idx, CASE WHEN (sample_idx // 26) % 2 = 0 THEN 'A' ELSE 'B' END AS state FROM sup),
ps AS (SELECT a.rec, a.bout_idx, a.state, a.unit_pos AS i, b.unit_pos AS j, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM wk a JOIN wk b ON a.rec = b.rec AND a.sample_idx = b.sample_idx AND a.unit_pos < b.unit_pos GROUP BY 1, 2, 3, 4, 5),
pb AS (SELECT *, CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS r FROM ps),
zb AS (SELECT *, atanh(greatest(-1 + 1e-7, least(1 - 1e-7, r))) AS z FROM pb),
fi AS (SELECT state, i, j, sum((n - 3) * z) / sum(n - 3) AS z, tanh(sum((n - 3) * z) / sum(n - 3)) AS r, 1 / sqrt(sum(n - 3)) AS se, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_bouts FROM zb WHERE r IS NOT NULL AND n > 3 GROUP BY 1, 2, 3),
cl AS (SELECT fi.*, CASE WHEN a.group_id = b.group_id THEN 'within_group' WHEN a.group_type = b.group_type THEN 'between_same_type' ELSE 'between_cross_type' END AS pair_type, least(a.group_type, b.group_type) || '_' || greatest(a.group_type, b.group_type) AS same_type, a.group_id AS gi, a.group_type AS ti FROM fi JOIN sgrp a ON a.unit_id = i JOIN sgrp b ON b.unit_id = j),
di AS (SELECT a.i, a.j, a.z AS z_a, b.z AS z_b, a.se AS se_a, b.se AS se_b, a.n_samples AS n_samples_a, b.n_samples AS n_samples_b, a.z - b.z AS delta, a.gi AS group_id, a.ti AS group_type FROM cl a JOIN fi b ON a.i = b.i AND a.j = b.j WHERE a.state = 'A' AND b.state = 'B')"""

QUERIES = {
    "pair_correlation": lambda s, d: rounded(pr.pearson(st.suppliers(s, d), ["rec"]), "r"),
    "pair_correlation_by_bout": lambda s, d: rounded(by_bout(s, d), "r"),
    "pair_simple_mean": lambda s, d: rounded(pr.simple_mean(by_bout(s, d), ["state"]), "r", "z"),
    "pair_fisher_mean": lambda s, d: rounded(fisher(s, d), "r", "z", "se"),
    "pair_pooled": lambda s, d: rounded(pr.pooled(weekly(s, d), ["rec", "state"]), "r", "se"),
    "pair_strata": lambda s, d: rounded(pr.stratified(classified(s, d), ["state"]), "mean_r", "median_r", "mean_z", "median_z"),
    "bout_synchrony": lambda s, d: rounded(pr.bout_synchrony(by_bout(s, d), st.supplier_groups(s, d), ["rec", "bout_idx"]), "mean_r", "median_r", "share_above", "mean_within_group", "mean_between_same_type", "mean_between_cross_type"),
    "pair_outliers": lambda s, d: rounded(pr.outliers(difference(s, d), 20), "delta", "z_a", "z_b", "se_a", "se_b"),
    "pair_lags": lambda s, d: rounded(pr.lagged(weekly(s, d), ["rec", "state"], 3), "peak_r"),
    "pair_matrix": matrix,
    "window_correlation": windows,
    "head_tail_drift": drift,
    "onset_windows": onset_windows,
    "transition_windows": transition_windows,
    "onset_synchrony": lambda s, d: rounded(dy.onset_synchrony(user_trace(s, d), st.states(s, d), "view", "click", 4, 2, 12, 0.3).withColumn("t_rel", F.col("t_rel").cast("double")), "valid_share", "mean_r", "share_above"),
    "cell_means": lambda s, d: rounded(dy.mean_by_bin(classified(s, d).withColumn("rec", F.floor(F.col("i") / st.PER_RECORDING)), ["between_same_type", "between_cross_type"], ["state"], "rec"), "mean", "sd"),
    "binned_synchrony": lambda s, d: rounded(dy.binned(by_bout(s, d).withColumn("x", F.round(F.abs("r"), 9)), ["state"], "x", "n"), "mean", "sem"),
    "rank_stability": stability,
    "principal_components": lambda s, d: loadings(s, d),
    "subspace_similarity": lambda s, d: dy.subspace_similarity(loadings(s, d).withColumnRenamed("bout_idx", "bout"), 3, ["rec"]),
    "paired_test": lambda s, d: rounded(ss.paired_test(difference(s, d)), "delta", "se", "zscore", "p").select("i", "j", "delta", "se", "zscore", "p"),
    "meta_analysis": lambda s, d: rounded(ss.meta_analysis(grouped_difference(s, d), "group_id"), "fixed", "random", "se", "tau2", "q", "low", "high"),
    "cluster_test": lambda s, d: rounded(ss.cluster_test(grouped_difference(s, d), "group_id"), "mean", "t", "p"),
    "bootstrap_means": lambda s, d: ss.bootstrap(grouped_difference(s, d), ["group_type", "group_id"], 50),
    "label_metrics": metrics,
}

ORACLES = {
    "pair_correlation": sql("""ps AS (SELECT a.rec, a.unit_pos AS i, b.unit_pos AS j, count(*) AS n, corr(a.value, b.value) AS r, var_pop(a.value) AS va, var_pop(b.value) AS vb FROM sup a JOIN sup b ON a.rec = b.rec AND a.sample_idx = b.sample_idx AND a.unit_pos < b.unit_pos GROUP BY 1, 2, 3)
SELECT rec, i, j, round(CASE WHEN n >= 2 AND va > 0 AND vb > 0 THEN r END, 6) AS r, n FROM ps"""),
    "pair_correlation_by_bout": sql(PAIRS + " SELECT rec, bout_idx, state, i, j, round(r, 6) AS r, n FROM pb"),
    "pair_simple_mean": sql(PAIRS + " SELECT state, i, j, round(avg(r), 6) AS r, CAST(sum(n) AS BIGINT) AS n_samples, count(r) AS n_bouts, round(CASE WHEN avg(r) IS NOT NULL THEN atanh(greatest(-1 + 1e-7, least(1 - 1e-7, avg(r)))) END, 6) AS z FROM pb GROUP BY 1, 2, 3"),
    "pair_fisher_mean": sql(PAIRS + " SELECT state, i, j, round(z, 6) AS z, round(r, 6) AS r, round(se, 6) AS se, n_samples, n_bouts FROM fi"),
    "pair_pooled": sql("""wk AS (SELECT *, sample_idx // 26 AS bout_idx, CASE WHEN (sample_idx // 26) % 2 = 0 THEN 'A' ELSE 'B' END AS state FROM sup), c AS (SELECT rec, state, bout_idx, sample_idx, unit_pos, value - avg(value) OVER (PARTITION BY bout_idx, unit_pos) AS v FROM wk),
s AS (SELECT a.rec, a.state, a.unit_pos AS i, b.unit_pos AS j, count(*) AS n, sum(a.v) AS sx, sum(b.v) AS sy, sum(a.v * a.v) AS sxx, sum(b.v * b.v) AS syy, sum(a.v * b.v) AS sxy FROM c a JOIN c b ON a.rec = b.rec AND a.sample_idx = b.sample_idx AND a.unit_pos < b.unit_pos GROUP BY 1, 2, 3, 4)
SELECT rec, state, i, j, round(CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END, 6) AS r, round(CASE WHEN n > 3 THEN 1 / sqrt(greatest(n - 3, 1)) END, 6) AS se, n FROM s"""),
    "pair_strata": sql(PAIRS + """, x AS (SELECT state, r, z, unnest(list_filter([pair_type, CASE WHEN pair_type <> 'within_group' THEN 'type_' || same_type END, 'all_pairs'], lambda v: v IS NOT NULL)) AS stratum FROM cl)
SELECT state, stratum, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.5), 6) AS median_r, round(avg(z), 6) AS mean_z, round(quantile_cont(z, 0.5), 6) AS median_z, count(*) AS n_pairs, count(r) AS n_with_data FROM x GROUP BY 1, 2"""),
    "bout_synchrony": sql(PAIRS + """, t AS (SELECT pb.*, CASE WHEN a.group_id = b.group_id THEN 'w' WHEN a.group_type = b.group_type THEN 's' ELSE 'c' END AS k FROM pb JOIN sgrp a ON a.unit_id = i JOIN sgrp b ON b.unit_id = j)
SELECT rec, bout_idx, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.5), 6) AS median_r, round(avg(CASE WHEN r > 0.2 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_above, round(avg(r) FILTER (WHERE k = 'w'), 6) AS mean_within_group, round(avg(r) FILTER (WHERE k = 's'), 6) AS mean_between_same_type, round(avg(r) FILTER (WHERE k = 'c'), 6) AS mean_between_cross_type, count(*) AS n_pairs FROM t GROUP BY 1, 2"""),
    "pair_outliers": sql(PAIRS + " SELECT i, j, round(z_a, 6) AS z_a, round(z_b, 6) AS z_b, round(se_a, 6) AS se_a, round(se_b, 6) AS se_b, n_samples_a, n_samples_b, round(delta, 6) AS delta, CAST(row_number() OVER (ORDER BY delta DESC, i, j) AS INT) AS rank FROM di ORDER BY delta DESC, i, j LIMIT 20"),
    "pair_lags": sql("""wk AS (SELECT *, CASE WHEN (sample_idx // 26) % 2 = 0 THEN 'A' ELSE 'B' END AS state FROM sup), c AS (SELECT *, value - avg(value) OVER w AS v, stddev_pop(value) OVER w AS sd FROM wk WINDOW w AS (PARTITION BY state, unit_pos)),
s AS (SELECT a.rec, a.state, a.unit_pos AS i, b.unit_pos AS j, a.sample_idx - b.sample_idx AS lag, sum(a.v * b.v) AS s, count(*) AS n, min(a.sd) AS sa, min(b.sd) AS sb FROM c a JOIN c b ON a.rec = b.rec AND a.state = b.state AND a.unit_pos < b.unit_pos AND a.sample_idx - b.sample_idx BETWEEN -3 AND 3 GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT s.*, s / (max(CASE WHEN lag = 0 THEN n END) OVER (PARTITION BY state, i, j) * sa * sb) AS r FROM s)
SELECT rec, state, i, j, first(lag ORDER BY round(abs(r), 9) DESC, lag) AS lag, round(first(r ORDER BY round(abs(r), 9) DESC, lag), 6) AS peak_r FROM r WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY 1, 2, 3, 4"""),
    "window_correlation": sql("""wn AS (SELECT start_time AS b_start, unnest(generate_series(0, (end_time - start_time - 12) // 6)) AS w FROM states WHERE end_time - start_time >= 12),
wa AS (SELECT b_start, w, t.* FROM wn JOIN trace t ON t.sample_idx BETWEEN b_start + w * 6 AND b_start + w * 6 + 12), ok AS (SELECT b_start, w, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS vs FROM wa GROUP BY 1, 2 HAVING avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) >= 0.5),
ps AS (SELECT a.b_start, a.w, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM wa a JOIN wa b ON a.b_start = b.b_start AND a.w = b.w AND a.sample_idx = b.sample_idx AND a.unit_id < b.unit_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.b_start, a.w, a.unit_id, b.unit_id),
pr AS (SELECT b_start, w, CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS r FROM ps)
SELECT b_start, w, round(min(vs), 6)::DOUBLE AS valid_share, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r > 0.2 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_above, count(r) AS n_pairs FROM ok JOIN pr USING (b_start, w) GROUP BY 1, 2"""),
    "transition_windows": sql("""rs AS (SELECT * FROM rec_states WHERE p = 0), cand AS (SELECT a.rec, a.start_time AS t0, a.end_time AS on_end, max(b.end_time) AS pre_end, arg_max(b.start_time, b.end_time) AS pre_start FROM rs a JOIN rs b
  ON a.rec = b.rec AND a.state = 'view' AND b.state = 'click' AND a.end_time - a.start_time >= 12 AND b.end_time BETWEEN a.start_time - 0.5 AND a.start_time + 0.01 GROUP BY 1, 2, 3),
tr AS (SELECT * FROM cand WHERE pre_end - pre_start >= 12),
sd AS (SELECT rec, t0, 'pre' AS phase, greatest(t0 - 20, pre_start) AS lo, t0 AS hi FROM tr UNION ALL SELECT rec, t0, 'post', t0, least(t0 + 16, on_end) FROM tr),
w AS (SELECT *, unnest(generate_series(0, CAST(floor((hi - lo - 8 + 1e-9) / 3.0) AS BIGINT))) AS k FROM sd WHERE hi - lo >= 8)
SELECT rec, t0, phase, k, round(lo + k * 3.0, 6)::DOUBLE AS w_start, (lo + k * 3.0 + 8)::DOUBLE AS w_end, (lo + k * 3.0 + 4 - t0)::DOUBLE AS t_rel FROM w"""),
    "onset_windows": sql("""tr AS (SELECT a.start_time AS t0, a.end_time AS on_end, max(b.end_time) AS pre_end, first(b.start_time ORDER BY b.end_time DESC) AS pre_start FROM states a JOIN states b ON a.state = 'view' AND b.state = 'click' AND b.end_time BETWEEN a.start_time - 0.5 AND a.start_time + 0.01 GROUP BY 1, 2),
w AS (SELECT *, unnest(generate_series(-6, 6)) AS k FROM tr)
SELECT t0, CAST(k AS INT) AS k, CAST(t0 + k * 2 AS DOUBLE) AS w_start, CAST(k * 2 + 2 AS DOUBLE) AS t_rel FROM w WHERE (k < 0 AND k * 2 + 4 <= 0 AND t0 + k * 2 >= pre_start) OR (k >= 0 AND t0 + k * 2 + 4 <= on_end)"""),
    "cell_means": sql(PAIRS + """, c AS (SELECT state, i // 25 AS rec, avg(r) AS m FROM cl WHERE pair_type <> 'within_group' GROUP BY 1, 2 HAVING avg(r) IS NOT NULL) SELECT state, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(m) AS n_cells FROM c GROUP BY 1"""),
    "onset_synchrony": sql("""tr AS (SELECT a.start_time AS t0, a.end_time AS on_end, max(b.end_time) AS pre_end, first(b.start_time ORDER BY b.end_time DESC) AS pre_start FROM states a JOIN states b ON a.state = 'view' AND b.state = 'click' AND b.end_time BETWEEN a.start_time - 0.5 AND a.start_time + 0.01 GROUP BY 1, 2),
w AS (SELECT *, unnest(generate_series(-6, 6)) AS k FROM tr), ow AS (SELECT t0, CAST(k AS INT) AS k, t0 + k * 2 AS w_start, CAST(k * 2 + 2 AS DOUBLE) AS t_rel FROM w WHERE (k < 0 AND k * 2 + 4 <= 0 AND t0 + k * 2 >= pre_start) OR (k >= 0 AND t0 + k * 2 + 4 <= on_end)),
wa AS (SELECT t0, k, t_rel, t.* FROM ow JOIN trace t ON t.sample_idx BETWEEN w_start AND w_start + 4), ok AS (SELECT t0, k, t_rel, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS vs FROM wa GROUP BY 1, 2, 3 HAVING avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) >= 0.3),
ps AS (SELECT a.t0, a.k, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM wa a JOIN wa b ON a.t0 = b.t0 AND a.k = b.k AND a.sample_idx = b.sample_idx AND a.unit_id < b.unit_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.t0, a.k, a.unit_id, b.unit_id),
pr AS (SELECT t0, k, CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS r FROM ps)
SELECT t0, k, t_rel, round(min(vs), 6)::DOUBLE AS valid_share, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r > 0.2 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_above, count(r) AS n_pairs FROM ok JOIN pr USING (t0, k) GROUP BY 1, 2, 3"""),
    "rank_stability": sql(PAIRS + """, z AS (SELECT rec, bout_idx, i, j, round(atanh(greatest(-1 + 1e-7, least(1 - 1e-7, r))), 9) AS z FROM pb WHERE r IS NOT NULL), b AS (SELECT a.rec, a.bout_idx, lag, a.z, c.z AS z2 FROM z a JOIN (VALUES (1), (2)) v(lag) ON true JOIN z c ON c.rec = a.rec AND c.i = a.i AND c.j = a.j AND c.bout_idx = a.bout_idx + lag),
k AS (SELECT rec, bout_idx, lag, rank() OVER (PARTITION BY rec, bout_idx, lag ORDER BY z) + (count(*) OVER (PARTITION BY rec, bout_idx, lag, z) - 1) / 2.0 AS x, rank() OVER (PARTITION BY rec, bout_idx, lag ORDER BY z2) + (count(*) OVER (PARTITION BY rec, bout_idx, lag, z2) - 1) / 2.0 AS y FROM b)
SELECT rec, bout_idx, CAST(lag AS INT) AS lag, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 5"""),
    "binned_synchrony": sql(PAIRS + """, b AS (SELECT state, least(floor(round(abs(r), 9) * 10), 9)::BIGINT AS bin, n FROM pb WHERE r IS NOT NULL)
SELECT state, bin, round(avg(n), 6) AS mean, count(n) AS n, round(CASE WHEN count(n) >= 2 THEN stddev_samp(n) / sqrt(count(n)) END, 6) AS sem FROM b GROUP BY 1, 2"""),
    "head_tail_drift": sql(PAIRS + """, v AS (SELECT *, row_number() OVER (w ORDER BY sample_idx) AS up, row_number() OVER (w ORDER BY sample_idx DESC) AS down, count(*) OVER w AS size FROM (SELECT DISTINCT rec, bout_idx, sample_idx FROM wk) WINDOW w AS (PARTITION BY rec, bout_idx)),
sd AS (SELECT rec, bout_idx, sample_idx, 'head' AS side FROM v WHERE size >= 10 AND up <= 5 UNION ALL SELECT rec, bout_idx, sample_idx, 'tail' FROM v WHERE size >= 10 AND down <= 5),
hs AS (SELECT rec, bout_idx, side, a.unit_pos AS i, b.unit_pos AS j, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM sd JOIN wk a USING (rec, bout_idx, sample_idx) JOIN wk b USING (rec, bout_idx, sample_idx) WHERE a.unit_pos < b.unit_pos GROUP BY 1, 2, 3, 4, 5),
hr AS (SELECT *, CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS r FROM hs),
hw AS (SELECT rec, bout_idx, i, j, max(r) FILTER (side = 'head') AS head, max(r) FILTER (side = 'tail') AS tail FROM hr GROUP BY 1, 2, 3, 4)
SELECT rec, bout_idx, i, j, round(head, 6) AS head, round(tail, 6) AS tail, round(tail - head, 6) AS delta_r, round(CASE WHEN tail IS NOT NULL AND head IS NOT NULL THEN atanh(greatest(-0.999999, least(0.999999, tail))) - atanh(greatest(-0.999999, least(0.999999, head))) END, 6) AS delta_z FROM hw"""),
    "pair_matrix": sql("""ps AS (SELECT a.rec, a.unit_pos % 25 AS i, b.unit_pos % 25 AS j, count(*) AS n, corr(a.value, b.value) AS r, var_pop(a.value) AS va, var_pop(b.value) AS vb FROM sup a JOIN sup b ON a.rec = b.rec AND a.sample_idx = b.sample_idx AND a.unit_pos < b.unit_pos GROUP BY 1, 2, 3),
pb AS (SELECT rec, i, j, CASE WHEN n >= 2 AND va > 0 AND vb > 0 THEN r END AS r FROM ps), sides AS (SELECT rec, i, j, r FROM pb UNION ALL SELECT rec, j, i, r FROM pb UNION ALL SELECT DISTINCT rec, u, u, 1.0 FROM (SELECT rec, i AS u FROM pb UNION SELECT rec, j FROM pb))
SELECT rec, i, """ + ", ".join(f"round(max(r) FILTER (j = {k}), 6) AS u{k}" for k in range(25)) + " FROM sides GROUP BY 1, 2"),
    "paired_test": None,
    "meta_analysis": sql(PAIRS + """, o AS (SELECT group_id, sum(delta / (se_a * se_a + se_b * se_b)) / sum(1 / (se_a * se_a + se_b * se_b)) AS y, sum(1 / (se_a * se_a + se_b * se_b)) AS w FROM di GROUP BY 1),
s AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * y) / sum(w) AS fixed, sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w) AS q FROM o), t AS (SELECT *, greatest(0.0, (q - (k - 1)) / (sw - sww / sw)) AS tau2 FROM s),
r AS (SELECT t.k, t.fixed, t.q, t.tau2, sum(y / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS rnd, 1 / sqrt(sum(1 / (1 / w + tau2))) AS se FROM o, t GROUP BY 1, 2, 3, 4)
SELECT k, round(fixed, 6) AS fixed, round(q, 6) AS q, round(tau2, 6) AS tau2, round(rnd, 6) AS random, round(se, 6) AS se, round(rnd - 1.959963984540054 * se, 6) AS low, round(rnd + 1.959963984540054 * se, 6) AS high FROM r"""),
    "label_metrics": sql(SWEPT + """, m AS (SELECT a_state AS truth, b_state AS pred, CAST(sum(duration) AS BIGINT) AS n FROM swept GROUP BY 1, 2),
l AS (SELECT label, CAST(coalesce(sum(n) FILTER (WHERE truth = label), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (WHERE pred = label), 0) AS BIGINT) AS predicted, CAST(coalesce(sum(n) FILTER (WHERE truth = label AND pred = label), 0) AS BIGINT) AS hits FROM m, (SELECT truth AS label FROM m UNION SELECT pred FROM m) GROUP BY 1),
q AS (SELECT *, (SELECT sum(n) FILTER (WHERE truth = pred) / sum(n) FROM m) AS accuracy, coalesce(hits / nullif(predicted, 0), 0.0) AS precision, coalesce(hits / nullif(support, 0), 0.0) AS recall FROM l)
SELECT label, support, predicted, hits, round(accuracy, 6)::DOUBLE AS accuracy, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6)::DOUBLE AS f1 FROM q"""),
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
