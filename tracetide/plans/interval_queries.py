"""Masks, states, tilings: queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracetide.operators import events as ev
from tracetide.operators import intervals as iv
from tracetide.plans import standins as st
from tracetide.plans.standins import sql

STATES = ["click", "view"]


def event_rate_by_state(spark, d):
    """Events of type error per unit and state, over the valid hours of the state."""
    tr = st.trace(spark, d)
    errors = st.timed_events(spark, d).where("event_type = 'error'").groupBy((F.col("user_id") % st.UNITS).alias("unit_id"), F.floor("t").alias("sample_idx")).agg(F.count(F.lit(1)).alias("n"))
    units = st.timed_events(spark, d).select((F.col("user_id") % st.UNITS).alias("unit_id"))
    out = ev.rate_by_state(tr.where("value is not null"), errors, st.states(spark, d), units, ["unit_id"])
    return out.select("unit_id", "state", F.col("valid_time").cast("long").alias("valid_h"), "n_events", F.round("rate", 9).alias("rate"))


def validity_masks(spark, d):
    tr = st.trace(spark, d)
    return iv.validity_mask(tr, [], "all").withColumnRenamed("is_valid", "all_valid").join(iv.validity_mask(tr, [], "any").withColumnRenamed("is_valid", "any_valid"), "sample_idx")


def span_tiles(spark, d):
    return iv.tile_span(st.mask(spark, d), st.states(spark, d), "view", 4, 2)


def state_segments(spark, d):
    return iv.state_valid_runs(st.mask(spark, d), st.states(spark, d), STATES)


def state_coverage(spark, d):
    s = st.states(spark, d)
    return iv.state_coverage(s, F.lit(100.0), F.lit(400.0)).withColumn("share", F.round("share", 9))


def coverage(spark, d):
    """States of every recording within ten days and a half of its first event."""
    s = st.recording_states(spark, d, 0)
    b = s.groupBy("rec").agg((F.min("start_time") + 3.0).alias("t0"), (F.min("start_time") + 255.0).alias("t1"))
    return iv.recording_coverage(s, b, ["rec"]).withColumn("share", F.round("share", 9))


def epochs(spark, d):
    top = st.states(spark, d).agg(F.floor(F.max("end_time") / 5).alias("n"))
    return top.where("n > 0").select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch_idx")).select("epoch_idx", (F.col("epoch_idx") * 5).alias("e_start"), (F.col("epoch_idx") * 5 + 5).alias("e_end"))


def epoch_labels(spark, d):
    lab = st.user_states(spark, d, 0).select(F.col("state").alias("label"), F.col("start_time").alias("l_start"), F.col("end_time").alias("l_end"))
    return iv.overlap_labels(epochs(spark, d), lab, 0.4).select("epoch_idx", "label", "overlap")


def recorded(spark, d):
    return iv.atomic_segments(st.recording_states(spark, d, 0), st.recording_states(spark, d, 1), ["rec"])


def atomic(spark, d):
    return recorded(spark, d).drop("b_start", "b_end")


def purity(spark, d):
    return iv.bout_purity(recorded(spark, d), ["rec"]).withColumn("purity", F.round("purity", 9))


def absorbed(spark, d):
    return iv.absorb_brief(st.recording_states(spark, d, 0), ["rec"], 13.0)


def clock_bins(spark, d):
    b = iv.state_bouts(st.mask(spark, d), st.states(spark, d))
    return iv.state_clock_bins(b, 10.0).select("state", "start_time", "bin", F.round("slice_start", 6).alias("slice_start"), F.round("slice_end", 6).alias("slice_end"))


BOUTS = """bouts AS (SELECT st.state, st.start_time, st.end_time, row_number() OVER (ORDER BY st.start_time) - 1 AS bout_idx, count(i.sample_idx) * 1.0 AS valid_duration, st.end_time - st.start_time AS wall_duration
  FROM states st LEFT JOIN inside i ON i.start_time = st.start_time AND i.is_valid GROUP BY 1, 2, 3)"""

SWEPT = """ed AS (SELECT DISTINCT rec, t FROM (SELECT rec, start_time AS t FROM rec_states UNION ALL SELECT rec, end_time FROM rec_states)), sg AS (SELECT rec, t, lead(t) OVER (PARTITION BY rec ORDER BY t) AS t2 FROM ed),
swept AS (SELECT sg.rec, t, t2, t2 - t AS duration, a.state AS a_state, b.state AS b_state, b.start_time AS p_start, b.end_time AS p_end FROM sg JOIN rec_states a ON a.rec = sg.rec AND a.p = 0 AND (t + t2) / 2.0 >= a.start_time AND (t + t2) / 2.0 < a.end_time
  JOIN rec_states b ON b.rec = sg.rec AND b.p = 1 AND (t + t2) / 2.0 >= b.start_time AND (t + t2) / 2.0 < b.end_time)"""

QUERIES = {
    "event_rate_by_state": event_rate_by_state,
    "validity_masks": validity_masks,
    "sample_step": lambda s, d: iv.sample_step(st.trace(s, d).where("value is not null"), ["unit_id"]).select("unit_id", "dt"),
    "valid_intervals": lambda s, d: iv.valid_intervals(st.mask(s, d), []),
    "valid_duration": lambda s, d: iv.valid_duration(st.trace(s, d).withColumn("is_valid", F.col("value").isNotNull()), ["unit_id"], 100, 500),
    "merged_states": lambda s, d: st.states(s, d),
    "state_valid_runs": state_segments,
    "strict_tiles": lambda s, d: iv.tile_strict(st.mask(s, d), st.states(s, d), "view", 3),
    "span_tiles": span_tiles,
    "state_bouts": lambda s, d: iv.state_bouts(st.mask(s, d), st.states(s, d)).drop("n_rows"),
    "bout_context": lambda s, d: iv.bout_context(iv.state_bouts(st.mask(s, d), st.states(s, d))).select("state", "start_time", "state_idx", "clock_start", "clock_end", "gap"),
    "state_clock_bins": clock_bins,
    "bout_periods": lambda s, d: iv.split_periods(st.states(s, d)).select("state", "start_time", "period"),
    "state_coverage": state_coverage,
    "epoch_labels": epoch_labels,
    "recording_coverage": coverage,
    "atomic_segments": atomic,
    "bout_purity": purity,
    "absorbed_states": absorbed,
}

ORACLES = {
    "recording_coverage": sql("""s AS (SELECT * FROM rec_states WHERE p = 0), b AS (SELECT rec, min(start_time) + 3.0 AS t0, min(start_time) + 255.0 AS t1 FROM s GROUP BY 1)
SELECT rec, state, sum(greatest(least(end_time, t1) - greatest(start_time, t0), 0.0))::DOUBLE AS seconds, round(sum(greatest(least(end_time, t1) - greatest(start_time, t0), 0.0))::DOUBLE / 252.0, 9)::DOUBLE AS share FROM s JOIN b USING (rec) GROUP BY 1, 2"""),
    "event_rate_by_state": sql("""u AS (SELECT t.unit_id, t.sample_idx, min(s.state) AS state FROM trace t JOIN states s ON t.sample_idx BETWEEN s.start_time AND s.end_time WHERE t.value IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
ev AS (SELECT unit_id, sample_idx, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY 1, 2),
r AS (SELECT u.unit_id, u.state, count(*) AS valid_h, coalesce(sum(n), 0) AS n_events FROM u LEFT JOIN ev USING (unit_id, sample_idx) GROUP BY 1, 2)
SELECT unit_id, state, coalesce(valid_h, 0) AS valid_h, CAST(coalesce(n_events, 0) AS BIGINT) AS n_events, round(CASE WHEN valid_h > 0 THEN n_events / CAST(valid_h AS DOUBLE) END, 9) AS rate
FROM (SELECT DISTINCT unit_id FROM trace) CROSS JOIN (SELECT DISTINCT state FROM states) LEFT JOIN r USING (unit_id, state)"""),
    "validity_masks": sql("SELECT sample_idx, bool_and(value IS NOT NULL) AS all_valid, bool_or(value IS NOT NULL) AS any_valid FROM trace GROUP BY 1"),
    "sample_step": sql("SELECT unit_id, quantile_cont(d, 0.5) AS dt FROM (SELECT unit_id, CAST(sample_idx - lag(sample_idx) OVER (PARTITION BY unit_id ORDER BY sample_idx) AS DOUBLE) AS d FROM trace WHERE value IS NOT NULL) GROUP BY 1"),
    "valid_intervals": sql("SELECT min(sample_idx) AS start_time, max(sample_idx) AS end_time, count(*) * 1.0::DOUBLE AS duration FROM (SELECT sample_idx, sample_idx - row_number() OVER (ORDER BY sample_idx) AS g FROM mask WHERE is_valid) GROUP BY g"),
    "valid_duration": sql("SELECT unit_id, (count(value) FILTER (WHERE sample_idx BETWEEN 100 AND 500)) * 1.0::DOUBLE AS valid_s FROM trace GROUP BY 1"),
    "merged_states": sql("SELECT * FROM states"),
    "state_valid_runs": sql("""i2 AS (SELECT m.sample_idx FROM mask m JOIN states st ON m.sample_idx BETWEEN st.start_time AND st.end_time WHERE m.is_valid AND st.state IN ('click', 'view') GROUP BY 1 HAVING count(*) = 1)
SELECT min(sample_idx) AS start_time, max(sample_idx) AS end_time, count(*) * 1.0::DOUBLE AS duration, 'click|view' AS state FROM (SELECT sample_idx, sample_idx - row_number() OVER (ORDER BY sample_idx) AS g FROM i2) GROUP BY g"""),
    "strict_tiles": sql("""i2 AS (SELECT m.sample_idx FROM mask m JOIN states st ON m.sample_idx BETWEEN st.start_time AND st.end_time WHERE m.is_valid AND st.state = 'view' GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT sample_idx, sample_idx - row_number() OVER (ORDER BY sample_idx) AS g FROM i2), k AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY sample_idx) - 1) // 3 AS k FROM r)
SELECT min(sample_idx) AS start_time, max(sample_idx) AS end_time, count(*) AS valid, 'view' AS state, max(sample_idx) - min(sample_idx) + 1 AS wall FROM k GROUP BY g, k HAVING count(*) = 3"""),
    "span_tiles": sql("""i2 AS (SELECT m.sample_idx, m.is_valid FROM mask m JOIN states st ON m.sample_idx BETWEEN st.start_time AND st.end_time WHERE st.state = 'view' GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT *, sample_idx - row_number() OVER (ORDER BY sample_idx) AS g FROM i2), v AS (SELECT *, sample_idx - lag(sample_idx) OVER (PARTITION BY g ORDER BY sample_idx) - 1 AS gap FROM r WHERE is_valid),
p AS (SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY sample_idx) AS part FROM v), k AS (SELECT *, (row_number() OVER (PARTITION BY g, part ORDER BY sample_idx) - 1) // 4 AS k FROM p)
SELECT min(sample_idx) AS start_time, max(sample_idx) AS end_time, count(*) AS valid, 'view' AS state, max(sample_idx) - min(sample_idx) + 1 AS wall FROM k GROUP BY g, part, k HAVING count(*) = 4"""),
    "state_bouts": sql(BOUTS + " SELECT state, start_time, end_time, bout_idx, CAST(valid_duration AS DOUBLE) AS valid_duration, wall_duration FROM bouts"),
    "bout_context": sql(BOUTS + """ SELECT state, start_time, row_number() OVER w - 1 AS state_idx, CAST(sum(valid_duration) OVER w - valid_duration AS DOUBLE) AS clock_start, CAST(sum(valid_duration) OVER w AS DOUBLE) AS clock_end, CAST(start_time - lag(end_time) OVER w AS DOUBLE) AS gap
FROM bouts WINDOW w AS (PARTITION BY state ORDER BY start_time)"""),
    "state_clock_bins": sql(BOUTS + """, c AS (SELECT *, sum(wall_duration) OVER (PARTITION BY state ORDER BY start_time) AS c1, sum(wall_duration) OVER (PARTITION BY state ORDER BY start_time) - wall_duration AS c0 FROM bouts),
x AS (SELECT *, unnest(generate_series(CAST(floor(c0 / 10.0) AS BIGINT), CAST(floor((c1 - 1e-12) / 10.0) AS BIGINT))) AS bin FROM c)
SELECT state, start_time, bin, round(start_time + greatest(c0, bin * 10.0) - c0, 6)::DOUBLE AS slice_start, round(start_time + least(c1, (bin + 1) * 10.0) - c0, 6)::DOUBLE AS slice_end FROM x"""),
    "bout_periods": sql("""SELECT state, start_time, ['early', 'middle', 'late'][CAST(least(floor(((start_time + end_time) / 2.0 - t0) / ((t1 - t0) / 3.0)), 2) AS INT) + 1] AS period
FROM states, (SELECT min(start_time) AS t0, max(end_time) AS t1 FROM states)"""),
    "state_coverage": sql("SELECT state, sum(greatest(least(end_time, 400.0) - greatest(start_time, 100.0), 0.0))::DOUBLE AS seconds, round(sum(greatest(least(end_time, 400.0) - greatest(start_time, 100.0), 0.0)) / 300.0, 9)::DOUBLE AS share FROM states GROUP BY 1"),
    "epoch_labels": sql("""ep AS (SELECT i AS epoch_idx, i * 5 AS e_start, i * 5 + 5 AS e_end FROM (SELECT unnest(range(0, max(end_time) // 5)) AS i FROM states)),
h AS (SELECT epoch_idx, state, least(e_end, end_time) - greatest(e_start, start_time) AS overlap, start_time, end_time FROM ep JOIN every_states s ON s.p = 0 AND start_time < e_end AND end_time > e_start),
b AS (SELECT *, row_number() OVER (PARTITION BY epoch_idx ORDER BY overlap DESC, start_time, end_time) AS r FROM h WHERE overlap >= 0.4 * 5)
SELECT epoch_idx, b.state AS label, overlap FROM ep LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (epoch_idx)"""),
    "atomic_segments": sql(SWEPT + " SELECT rec, t, t2, duration, a_state, b_state FROM swept"),
    "bout_purity": sql(SWEPT + """, d AS (SELECT rec, p_start, p_end, a_state, sum(duration) AS d FROM swept GROUP BY ALL)
SELECT rec, p_start, p_end, first(a_state ORDER BY d DESC, a_state) AS dominant, CAST(sum(d) AS BIGINT) AS total, round(max(d) / sum(d), 9)::DOUBLE AS purity FROM d GROUP BY 1, 2, 3"""),
    "absorbed_states": sql("""x AS (SELECT rec, state, start_time::DOUBLE AS s, end_time::DOUBLE AS e, row_number() OVER (PARTITION BY rec ORDER BY start_time) AS i FROM rec_states WHERE p = 0),
fold AS (SELECT rec, 1 AS i, [{'state': state, 's': s, 'e': e}] AS st FROM x WHERE i = 1
  UNION ALL SELECT x.rec, x.i, CASE WHEN len(st) > 1 AND st[len(st) - 1].state = x.state AND st[len(st)].e - st[len(st)].s < 13 THEN list_append(st[1:len(st) - 2], {'state': x.state, 's': st[len(st) - 1].s, 'e': x.e})
    ELSE list_append(st, {'state': x.state, 's': x.s, 'e': x.e}) END FROM fold JOIN x ON x.rec = fold.rec AND x.i = fold.i + 1)
SELECT rec, r.state, r.s AS start_time, r.e AS end_time FROM (SELECT rec, unnest(st) AS r FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY i DESC) AS k FROM fold) WHERE k = 1)""").replace("WITH\n", "WITH RECURSIVE\n", 1),
}
