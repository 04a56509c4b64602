"""Compositions and small table rules: queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracetide.functions import rules
from tracetide.operators import clock as ck
from tracetide.operators import dynamics as dy
from tracetide.operators import geometry as ge
from tracetide.operators import intervals as iv
from tracetide.operators import tables as tt
from tracetide.plans import standins as st
from tracetide.plans.interval_queries import BOUTS
from tracetide.plans.pair_queries import user_trace
from tracetide.plans.signal_queries import rounded
from tracetide.plans.standins import sql, table


def bouts(spark, d):
    return iv.state_bouts(st.mask(spark, d), st.states(spark, d))


def units(spark, d):
    return user_trace(spark, d).select("unit_id").distinct().select("unit_id", (F.col("unit_id") % 4).alias("group_id"), (F.col("unit_id") % 2).alias("group_type"))


def pair_table(spark, d):
    return rounded(tt.state_pair_table(user_trace(spark, d), bouts(spark, d), units(spark, d)), "r", "z", "se", n=5).select("state", "i", "j", "r", "z", "se", "n_samples", "n_bouts", "pair_type", "same_type")


def period_table(spark, d):
    b = iv.split_periods(bouts(spark, d))
    return rounded(tt.state_pair_table(user_trace(spark, d), b, units(spark, d), extra=["period"]), "z", n=5).select("state", "period", "i", "j", "z", "n_samples", "n_bouts")


def clock_pairs(spark, d):
    return rounded(tt.clock_pair_table(user_trace(spark, d), bouts(spark, d), 24.0), "z", n=5).select("state", "bin", "i", "j", "z", "n_samples", "n_bouts")


def timeline(spark, d):
    return rounded(tt.bout_timeline(user_trace(spark, d), bouts(spark, d), 6, 3, 0.4, 10.0), "place", "mean_r", n=5)


def frames(spark, d):
    l = table(spark, d, "lineitem")
    pixels = l.groupBy((F.col("l_suppkey") % 4).alias("y"), (F.col("l_partkey") % 5).alias("x"), F.year(F.col("l_shipdate").cast("date")).alias("frame")).agg(F.sum("l_quantity").alias("grey"))
    return rounded(ge.frame_differences(pixels, pixels.where("x <> 2")), "change")


def lids(spark, d):
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 4).alias("frame"), F.element_at(F.array(*map(F.lit, ["m", "l", "a", "b"])), (F.col("c_custkey") % 4 + 1).cast("int")).alias("part"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_acctbal") % 37).alias("y"), F.lit(0.5).alias("likelihood"))
    return rounded(ge.eyelid_openness(c, ["frame"], "m", "l", [("a", "b")]), "width", "open", "open_norm", n=5)


def device(spark, d):
    e = st.timed_events(spark, d).select("user_id", "event_id", "t", "event_type", F.col("value").alias("offset"))
    return rounded(tt.device_clock(e, ["user_id"], "event_id", "t", "event_type", "offset"), "since_first", "block_time", n=5).select("event_id", "since_first", "block_time")


def closest(spark, d):
    a = table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 10).alias("gap"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_acctbal") / 20).alias("offset"))
    return ck.closest_candidate(a, b, "c_nationkey", F.col("gap")).select("c_custkey", F.round("offset", 6).alias("offset"))


def onset_baseline(spark, d):
    t = st.trace(spark, d).where("value is not null").select("unit_id", (F.col("sample_idx") - 300).alias("t_rel"), "value")
    return rounded(tt.less_baseline(t, ["unit_id"], "t_rel", "value"), "value", n=8)


def mismatch(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("session_id"), F.floor(F.col("o_orderkey") / 7).alias("epoch_idx"), F.col("o_orderstatus").alias("truth"), F.element_at(F.array(F.lit("O"), F.lit("F"), F.lit("P")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("pred"))
    return tt.mismatches(o, "session_id", "truth", "pred")


FRAMES = "px AS (SELECT l_suppkey % 4 AS y, l_partkey % 5 AS x, year(l_shipdate) AS frame, sum(l_quantity) AS grey FROM lineitem GROUP BY 1, 2, 3)"
FISHER = """ib AS (SELECT b.*, t.unit_id, t.sample_idx, t.value FROM {b} b JOIN trace t ON t.sample_idx BETWEEN b.start_time AND b.end_time WHERE t.value IS NOT NULL {w}),
ps AS (SELECT a.bout_idx, a.state{k}, a.unit_id AS i, b.unit_id AS j, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM ib a JOIN ib b ON a.bout_idx = b.bout_idx AND a.state = b.state AND a.sample_idx = b.sample_idx AND a.unit_id < b.unit_id GROUP BY ALL),
rr AS (SELECT *, CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS r FROM ps),
fz AS (SELECT state{g}, i, j, sum((n - 3) * atanh(greatest(-1 + 1e-7, least(1 - 1e-7, r)))) / sum(n - 3) AS z, 1 / sqrt(sum(n - 3)) AS se, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_bouts FROM rr WHERE r IS NOT NULL AND n > 3 GROUP BY ALL)"""

QUERIES = {
    "state_pair_table": pair_table,
    "period_pair_table": period_table,
    "clock_pair_table": clock_pairs,
    "bout_timeline": timeline,
    "frame_differences": frames,
    "eyelid_openness": lids,
    "device_clock": device,
    "closest_candidate": closest,
    "onset_baseline": onset_baseline,
    "state_quartiles": lambda s, d: tt.quartiles(st.states(s, d).withColumn("d", F.col("end_time") - F.col("start_time")), ["state"], "d"),
    "label_mismatches": mismatch,
    "combined_units": lambda s, d: tt.combine({k: st.suppliers(s, d).where(F.col("unit_id") % 2 == k - 1).select("unit_id", "sample_idx", "value") for k in (1, 2)}),
    "unit_positions": lambda s, d: tt.with_positions(st.supplier_groups(s, d), table(s, d, "supplier").where("s_acctbal > 0").groupBy((F.floor(F.col("s_suppkey") / st.PER_RECORDING) * 25 + F.col("s_nationkey")).alias("group_id")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("unit_order"))),
    "bout_midpoints": lambda s, d: dy.bout_midpoints(bouts(s, d).select("bout_idx", "valid_duration"), bouts(s, d), ["bout_idx"], "valid_duration").withColumn("midpoint", F.col("midpoint").cast("double")),
    "newest_model": lambda s, d: tt.newest(table(s, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").cast("string").alias("day")), "name", "day"),
    "units_by_group": lambda s, d: tt.time_slice(tt.of_units(st.suppliers(s, d), st.supplier_groups(s, d), F.col("group_type").isin(0, 1)), 1460, 1500).select("unit_id", "sample_idx", "value"),
    "incomplete_pages": lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(rules.split_id(F.concat_ws("--", "lang", "source"))["loc"], F.lit("?")).alias("loc")).join(table(s, d, "pages"), F.col("doc_id") == F.col("page_id"), "left_anti"),
}

ORACLES = {
    "eyelid_openness": """WITH c AS (SELECT c_custkey // 4 AS frame, c_custkey % 4 AS part, c_acctbal / 100 AS x, c_acctbal % 37 AS y FROM customer),
w AS (SELECT frame, max(x) FILTER (WHERE part = 0) AS mx, max(y) FILTER (WHERE part = 0) AS my, max(x) FILTER (WHERE part = 1) AS lx, max(y) FILTER (WHERE part = 1) AS ly,
  max(x) FILTER (WHERE part = 2) AS ax, max(y) FILTER (WHERE part = 2) AS ay, max(x) FILTER (WHERE part = 3) AS bx, max(y) FILTER (WHERE part = 3) AS by_ FROM c GROUP BY 1),
d AS (SELECT frame, sqrt((lx - mx) * (lx - mx) + (ly - my) * (ly - my)) AS width, abs((ay - by_) * (lx - mx) - (ax - bx) * (ly - my)) AS cross_ FROM w)
SELECT frame, round(width, 5) AS width, round(cross_ / width, 5) AS open, round(cross_ / width / width, 5) AS open_norm FROM d""",
    "bout_timeline": sql(BOUTS + """, lg AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY start_time) - 1 AS state_idx FROM bouts WHERE valid_duration >= 10),
wn AS (SELECT *, unnest(generate_series(0, (end_time - start_time - 6) // 3)) AS w FROM lg WHERE end_time - start_time >= 6), wa AS (SELECT bout_idx, w, t.* FROM wn JOIN trace t ON t.sample_idx BETWEEN wn.start_time + w * 3 AND wn.start_time + w * 3 + 6),
ok AS (SELECT bout_idx, w FROM wa GROUP BY 1, 2 HAVING avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) >= 0.4),
ps AS (SELECT a.bout_idx, a.w, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM wa a JOIN wa b ON a.bout_idx = b.bout_idx AND a.w = b.w AND a.sample_idx = b.sample_idx AND a.unit_id < b.unit_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.bout_idx, a.w, a.unit_id, b.unit_id),
pr AS (SELECT bout_idx, w, CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS r FROM ps)
SELECT bout_idx, w, state, state_idx, round((w * 3 + 3) / (end_time - start_time)::DOUBLE, 5) AS place, round(avg(r), 5) AS mean_r, count(r) AS n_pairs FROM ok JOIN pr USING (bout_idx, w) JOIN wn USING (bout_idx, w) GROUP BY bout_idx, w, state, state_idx, start_time, end_time"""),
    "bout_midpoints": sql(BOUTS + " SELECT bout_idx, state, (start_time + end_time) / 2.0::DOUBLE AS midpoint, valid_duration::DOUBLE AS valid_duration FROM bouts"),
    "newest_model": "SELECT name, day, sha256(name || '|' || day) AS signature FROM (SELECT o_orderpriority AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY day DESC, name DESC LIMIT 1)",
    "clock_pair_table": sql(BOUTS + """, bc AS (SELECT *, sum(wall_duration) OVER (PARTITION BY state ORDER BY start_time) AS ce FROM bouts), bn AS (SELECT *, ce - wall_duration AS cs FROM bc WHERE wall_duration > 0),
bx AS (SELECT *, unnest(generate_series(CAST(floor(cs / 24.0) AS BIGINT), CAST(floor((ce - 1e-12) / 24.0) AS BIGINT))) AS bin FROM bn),
sl AS (SELECT state, bin, start_time + (greatest(cs, bin * 24.0) - cs) AS start_time, start_time + (least(ce, (bin + 1) * 24.0) - cs) AS end_time FROM bx), pd AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY start_time) AS bout_idx FROM sl),
""" + FISHER.format(b="pd", w="", k=", a.bin", g=", bin") + " SELECT state, bin, i, j, round(z, 5) AS z, n_samples, n_bouts FROM fz"),
    "state_pair_table": sql(BOUTS + ",\n" + FISHER.format(b="bouts", w="", k="", g="") + """ SELECT state, i, j, round(tanh(z), 5) AS r, round(z, 5) AS z, round(se, 5) AS se, n_samples, n_bouts,
CASE WHEN i % 4 = j % 4 THEN 'within_group' WHEN i % 2 = j % 2 THEN 'between_same_type' ELSE 'between_cross_type' END AS pair_type, least(i % 2, j % 2) || '_' || greatest(i % 2, j % 2) AS same_type FROM fz"""),
    "period_pair_table": sql(BOUTS + """, pd AS (SELECT b.*, ['early', 'middle', 'late'][CAST(least(floor(((start_time + end_time) / 2.0 - t0) / ((t1 - t0) / 3.0)), 2) AS INT) + 1] AS period FROM bouts b, (SELECT min(start_time) AS t0, max(end_time) AS t1 FROM bouts)),
""" + FISHER.format(b="pd", w="", k=", a.period", g=", period") + " SELECT state, period, i, j, round(z, 5) AS z, n_samples, n_bouts FROM fz"),
    "frame_differences": "WITH " + FRAMES + ", d AS (SELECT frame, abs(grey - lag(grey) OVER (PARTITION BY y, x ORDER BY frame)) AS d FROM px WHERE x <> 2) SELECT CAST(frame AS INT) AS frame, round(coalesce(avg(d), 0), 6)::DOUBLE AS change FROM d GROUP BY 1",
    "device_clock": sql("SELECT event_id, round(t - first_value(t) OVER (PARTITION BY user_id ORDER BY event_id), 5) AS since_first, round(first_value(value) OVER w + t - first_value(t) OVER w, 5) AS block_time FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)"),
    "closest_candidate": "SELECT c_custkey, round(first(s_acctbal / 20 ORDER BY abs(s_acctbal / 20 - abs(c_acctbal / 10)), s_acctbal / 20), 6) AS offset FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1",
    "onset_baseline": sql("SELECT unit_id, sample_idx - 300 AS t_rel, round(value - avg(CASE WHEN sample_idx < 300 THEN value END) OVER (PARTITION BY unit_id), 8) AS value FROM trace WHERE value IS NOT NULL"),
    "state_quartiles": sql("SELECT state, quantile_cont(end_time - start_time, 0.25)::DOUBLE AS q1, quantile_cont(end_time - start_time, 0.5)::DOUBLE AS median, quantile_cont(end_time - start_time, 0.75)::DOUBLE AS q3, count(*) AS n FROM states GROUP BY 1"),
    "label_mismatches": """WITH o AS (SELECT o_orderkey % 7 AS session_id, o_orderkey // 7 AS epoch_idx, o_orderstatus AS truth, ['O', 'F', 'P'][o_custkey % 3 + 1] AS pred FROM orders), b AS (SELECT *, epoch_idx - row_number() OVER (PARTITION BY session_id, truth, pred ORDER BY epoch_idx) AS g FROM o WHERE truth <> pred)
SELECT session_id, truth, pred, min(epoch_idx) AS first_epoch, count(*) AS n_epochs FROM b GROUP BY session_id, truth, pred, g""",
    "combined_units": sql("SELECT CAST(unit_id % 2 + 1 AS INT) AS dmd, (unit_id % 2 + 1) || '-' || unit_id AS unit_id, sample_idx, value FROM sup"),
    "unit_positions": sql("SELECT unit_id, group_id, group_type, CAST(row_number() OVER (PARTITION BY group_id ORDER BY s_suppkey) - 1 AS INT) AS pos FROM sgrp JOIN supplier s ON s_suppkey = unit_id WHERE s_acctbal > 0 UNION ALL SELECT unit_id, group_id, group_type, NULL FROM sgrp JOIN supplier s ON s_suppkey = unit_id WHERE NOT s_acctbal > 0"),
    "units_by_group": sql("SELECT unit_id, sample_idx, value FROM sup WHERE unit_id IN (SELECT unit_id FROM sgrp WHERE group_type IN (0, 1)) AND sample_idx BETWEEN 1460 AND 1500"),
    "incomplete_pages": "SELECT doc_id, coalesce(lang, '?') AS loc FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)",
}
