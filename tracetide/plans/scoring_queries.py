"""Epoch features, classification and decoding: queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracetide.operators import boosting as bo
from tracetide.operators import features as fe
from tracetide.operators import scoring as sc
from tracetide.operators import sessions as se
from tracetide.operators import signals as sg
from tracetide.operators.blocks import cut
from tracetide.plans import standins as st
from tracetide.plans.signal_queries import rounded
from tracetide.plans.standins import sql, table
from tracetide.sources import tables as tb
from tracetide.streaming.refresh import windowed_rates

STATES = ["a", "b", "c"]


def sessions(spark, d):
    """Trace hours as epochs of a session a unit."""
    return st.trace(spark, d).select(F.col("unit_id").alias("session_id"), F.col("sample_idx").alias("epoch_idx"), "value")


def day_samples(spark, d):
    return st.trace(spark, d).withColumn("day", F.floor(F.col("sample_idx") / 24))


def labelled(spark, d):
    """Vectors as epochs: all components, three classes, five subjects, sessions of a thousand epochs."""
    v = table(spark, d, "embeddings")
    cols = [F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(width(v))]
    return v.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 5).alias("subject_id"), F.floor(F.col("vec_id") / 1000).alias("session_id"), (F.col("vec_id") % 1000).alias("epoch_idx"), F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("label") % 3 + 1).cast("int")).alias("label"), *cols)


def width(vectors):
    return vectors.agg(F.max(F.size("embedding"))).first()[0]


def features(df):
    return [c for c in df.columns if c[0] == "f" and c[1:].isdigit()]


BASKET = ["n_lines", "quantity", "discount", "price", "parts"]


def baskets(spark, d):
    """Orders as epochs of a customer, in a state that follows from two of their measures at a time."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id"))
    x = l.agg(F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").cast("double").alias("quantity"), F.avg("l_discount").alias("discount"), F.sum("l_extendedprice").cast("double").alias("price"), F.countDistinct("l_partkey").cast("double").alias("parts"))
    state = F.when((F.col("quantity") > 60) & (F.col("discount") > 0.05), "a").when(F.col("price") / F.col("n_lines") > 52_000, "b").otherwise("c")
    return x.withColumn("label", state)


def boosted(spark, d):
    """Every order judged by an ensemble of the other folds' rows, three in four taught."""
    df = cut(baskets(spark, d))
    out = bo.boosted_probabilities(df, bo.train_boosted(df.where("row_id % 4 > 0"), BASKET, STATES, rounds=10))
    return sc.argmax_label(out, STATES).select("row_id", "label", "pred_label", *[f"P_{x}" for x in STATES])


def smooth_decoded(spark, d):
    """The boosted probabilities in order of the orders, a thousand to a session, decoded with self transitions."""
    p = boosted(spark, d).select(F.floor(F.col("row_id") / 1000).alias("session_id"), (F.col("row_id") % 1000).alias("epoch_idx"), *[f"P_{x}" for x in STATES])
    return sc.decode_sessions(p, sc.Durations.smooth(STATES, {x: 6.0 for x in STATES}, 2.0, 0.5, longest_s=60.0))


HOURS = se.Plan(fs=4.0, fs_frames=1.0, epoch_s=12.0, context=("diam_mean",), context_windows=(3, 5), median_s={x: 48.0 for x in sc.STATES}, sigma={x: 1.0 for x in sc.STATES}, longest_s=240.0)


def session_bouts(spark, d):
    """Five users to a session: events are its samples and frames, in hours; the commonest events of the even users label it."""
    e = st.timed_events(spark, d).withColumn("session_id", F.floor(F.col("user_id") / 5))
    eye = e.select("session_id", F.col("event_id").alias("frame"), F.col("value").alias("diameter"), (F.col("value") * 2).alias("motion"), (F.col("value") % 7).alias("eyelid"), (F.col("event_id") % 10 / 10).alias("eyelid_norm"))
    whisk = e.select("session_id", F.col("event_id").alias("frame"), "t", F.col("value").alias("whisking"))
    session = se.assemble(e.select("session_id", "t", "value"), eye, whisk)
    labels = st.recording_states(spark, d, 0).select(F.col("rec").alias("session_id"), F.col("state").alias("label"), F.col("start_time").alias("l_start"), F.col("end_time").alias("l_end"))
    labels = labels.withColumn("label", F.try_element_at(F.create_map(*[F.lit(x) for x in ("click", "N", "error", "REM", "view", "wake")]), "label")).where("label is not null")
    table = se.session_features(session, HOURS)
    return se.score_sessions(session, se.train_sessions(session, labels, HOURS, folds=2, rounds=3, features=table), HOURS, table).bouts


def probabilities(spark, d):
    df = labelled(spark, d)
    return sc.argmax_label(sc.state_probabilities(df, sc.train_states(df, features(df), STATES)), STATES)


def decoded(spark, d):
    return sc.decode_sessions(probabilities(spark, d), sc.Durations.build(STATES, {s: 10.0 for s in STATES}, {s: 1.0 for s in STATES}, 2.0, 60.0))


def context(spark, d):
    out = sc.context_features(sessions(spark, d), "session_id", ["value"], (5, 15))
    return rounded(out, "value_mean5", "value_std5", "value_mean15", "value_diff5", "value_diff15")


def grid(spark, d):
    r = st.timed_events(spark, d).groupBy("user_id", "event_type").agg(F.floor(F.min("t")).alias("t0"), F.floor(F.max("t")).alias("t1")).withColumnRenamed("user_id", "session_id")
    return sc.epoch_grid(r, 24).select("session_id", "epoch_idx", F.col("e_start").cast("double").alias("e_start"), F.col("e_end").cast("double").alias("e_end"))


def rates(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    r = windowed_rates(e, "ts", "event_type", "6 hours", "1 hour")
    return rounded(r.select(((F.unix_timestamp("window.start") - st.T0) / 3600).cast("long").alias("start_hour"), "event_type", "n", "mean_value"), "mean_value")


def scaled(spark, d):
    return rounded(sc.robust_scale(sessions(spark, d), "session_id", ["value"]), "value")


def frames(spark, d):
    """Events as frames of a user's epochs of three days, with measures and flags."""
    e = st.timed_events(spark, d)
    return e.select(F.col("user_id").alias("session_id"), F.floor(F.col("t") / 72).alias("epoch_idx"), F.col("event_id").alias("frame"), "t", F.col("value").alias("diameter"), (F.col("value") * 2).alias("motion"), (F.col("value") % 7).alias("eyelid"), (F.col("event_id") % 10 / 10).alias("eyelid_norm"), F.col("value").alias("whisking"), (F.col("event_type") != "error").alias("pupil_ok"), F.col("event_type").isin("click", "view").alias("motion_ok"), (F.col("event_id") % 5 != 0).alias("eyelid_ok"), (F.col("event_id") % 7 != 0).alias("whisk_ok"), (F.col("event_type") == "error").alias("camera_off"))


EPOCH = ["session_id", "epoch_idx"]


def pupil(spark, d):
    out = fe.pupil_features(frames(spark, d), EPOCH, 0.05, 72)
    return rounded(out, *[c for c in out.columns if c not in EPOCH], n=5)


def whisking(spark, d):
    out = fe.whisking_features(frames(spark, d), EPOCH, 0.05, 72)
    return rounded(out, "whisk_mean", "whisk_std", "whisk_iqr", "whisk_active", n=5)


def quality(spark, d):
    return rounded(fe.quality_features(frames(spark, d), EPOCH), "pupil_share", "eyelid_share", "whisk_share", "off_share")


def epoch_table(spark, d):
    """All features: hours of the trace as voltage, events as frames, epochs of three days from the trace's start."""
    t = st.trace(spark, d).where("value is not null").select(F.col("unit_id").alias("session_id"), F.col("sample_idx").cast("double").alias("t"), "value")
    epochs = sc.epoch_grid(t.groupBy("session_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")), 72)
    f = frames(spark, d).withColumn("session_id", F.col("session_id") % st.UNITS).drop("epoch_idx")
    return fe.feature_table(epochs, t, f, "session_id", 8.0, 0.05, 72)


def complete(spark, d):
    return tb.complete_only(st.trace(spark, d), [])


QUERIES = {
    "epoch_grid": grid,
    "context_features": context,
    "robust_scaled": scaled,
    "imputed": lambda s, d: rounded(sc.impute(sessions(s, d), "session_id", ["value"]), "value"),
    "epoch_statistics": lambda s, d: rounded(sc.epoch_statistics(day_samples(s, d), ["unit_id", "day"], "value", 24, "v"), "v_mean", "v_std", "v_iqr", "v_speed", "v_valid", n=8),
    "bout_activity": lambda s, d: rounded(sc.bout_activity(day_samples(s, d).where("value is not null"), ["unit_id", "day"], "unit_id", "value"), "active_share"),
    "spectral_features": lambda s, d: sc.spectral_features(sg.fill_linear(day_samples(s, d), ["unit_id"]).select("unit_id", "day", "sample_idx", F.col("filled").alias("value")), ["unit_id", "day"], 24.0),
    "balanced_weights": lambda s, d: rounded(sc.balanced_weights(table(s, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))), "weight"),
    "state_probabilities": lambda s, d: probabilities(s, d).select("row_id", "label", "pred_label", *[f"P_{x}" for x in STATES]),
    "boosted_states": boosted,
    "session_bouts": session_bouts,
    "smooth_decoded_states": smooth_decoded,
    "decoded_states": decoded,
    "decoded_bouts": lambda s, d: sc.bouts_from_epochs(decoded(s, d).join(probabilities(s, d).select("session_id", "epoch_idx", "P_a"), ["session_id", "epoch_idx"]), "session_id", "state", ["P_a"]),
    "leave_one_out": lambda s, d: sc.leave_one_out(v := labelled(s, d), features(v), STATES, "subject_id"),
    "pupil_features": pupil,
    "whisking_features": whisking,
    "video_quality": quality,
    "epoch_feature_table": epoch_table,
    "windowed_rates": rates,
    "complete_samples": complete,
    "long_metrics": lambda s, d: tb.to_long(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]),
    "preferred_labels": lambda s, d: tb.prefer([table(s, d, "labels").where("quality = 1").select("doc_id", F.lit("validated").alias("origin")), table(s, d, "labels").select("doc_id", F.lit("scored").alias("origin"))], ["doc_id"]).drop("priority"),
}

FRAMES = """f AS (SELECT user_id AS session_id, CAST(floor(t / 72) AS BIGINT) AS epoch_idx, event_id AS frame, t, value, value % 7 AS eyelid, event_id % 10 / 10.0 AS eyelid_norm, event_type <> 'error' AS pupil_ok, event_type IN ('click', 'view') AS motion_ok, event_id % 5 <> 0 AS eyelid_ok, event_id % 7 <> 0 AS whisk_ok FROM te),
ep AS (SELECT DISTINCT session_id, epoch_idx FROM f)"""

ORACLES = {
    "pupil_features": sql(FRAMES + """, v AS (SELECT *, CASE WHEN t > pt THEN (value - pv) / (t - pt) END AS v FROM (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM f WHERE pupil_ok WINDOW w AS (PARTITION BY session_id, epoch_idx ORDER BY frame))),
a AS (SELECT session_id, epoch_idx, avg(value) AS diam_mean, stddev_pop(value) AS diam_std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS diam_iqr, avg(abs(v)) AS speed_mean, stddev_pop(v) AS speed_std, avg(CASE WHEN v < 0 THEN 1.0 WHEN v >= 0 THEN 0.0 END) AS constriction_rate FROM v GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT session_id, epoch_idx, avg(value * 2) AS motion_mean, stddev_pop(value * 2) AS motion_std FROM f WHERE motion_ok GROUP BY 1, 2 HAVING count(*) >= 2),
l AS (SELECT session_id, epoch_idx, avg(eyelid) AS eyelid_mean, stddev_pop(eyelid) AS eyelid_std, avg(eyelid_norm) AS eyelid_norm_mean, avg(CASE WHEN eyelid_norm < 0.3 THEN 1.0 ELSE 0.0 END) AS closed_share FROM f WHERE eyelid_ok GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT session_id, epoch_idx, """ + ", ".join(f"round({c}, 5)::DOUBLE AS {c}" for c in ("diam_mean", "diam_std", "diam_iqr", "speed_mean", "speed_std", "constriction_rate", "motion_mean", "motion_std", "eyelid_mean", "eyelid_std", "eyelid_norm_mean", "closed_share")) + " FROM ep LEFT JOIN a USING (session_id, epoch_idx) LEFT JOIN m USING (session_id, epoch_idx) LEFT JOIN l USING (session_id, epoch_idx)"),
    "whisking_features": sql(FRAMES + """, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY session_id, epoch_idx) AS m FROM f WHERE whisk_ok), u AS (SELECT *, value > m + 3 * (quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY session_id, epoch_idx) + 1e-9) AS up FROM m), w AS (SELECT *, lag(up) OVER (PARTITION BY session_id, epoch_idx ORDER BY frame) AS was FROM u),
a AS (SELECT session_id, epoch_idx, avg(value) AS wm, stddev_pop(value) AS ws, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS wq, avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) AS wa, count(*) FILTER (WHERE up AND NOT was) AS wb FROM w GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT session_id, epoch_idx, round(wm, 5) AS whisk_mean, round(ws, 5) AS whisk_std, round(wq, 5) AS whisk_iqr, round(wa, 5)::DOUBLE AS whisk_active, wb AS whisk_bursts FROM ep LEFT JOIN a USING (session_id, epoch_idx)"""),
    "video_quality": sql(FRAMES + """, q AS (SELECT session_id, epoch_idx, avg(pupil_ok::INT) AS p, avg(eyelid_ok::INT) AS l, avg(whisk_ok::INT) AS w, avg((NOT pupil_ok)::INT) AS o FROM f GROUP BY 1, 2)
SELECT session_id, epoch_idx, round(p, 6) AS pupil_share, round(l, 6) AS eyelid_share, round(w, 6) AS whisk_share, round(o, 6) AS off_share, CASE WHEN o >= 0.8 THEN 1.0 ELSE 0.0 END::DOUBLE AS camera_off_epoch FROM q"""),
    "epoch_grid": sql("""r AS (SELECT user_id, event_type, floor(min(t)) AS t0, floor(max(t)) AS t1 FROM e GROUP BY 1, 2), s AS (SELECT user_id AS session_id, max(t0) AS a, min(t1) AS b FROM r GROUP BY 1),
k AS (SELECT *, unnest(generate_series(0, CAST(floor((b - a) / 24) AS BIGINT) - 1)) AS epoch_idx FROM s WHERE b - a >= 24) SELECT session_id, epoch_idx, a + epoch_idx * 24 AS e_start, a + (epoch_idx + 1) * 24 AS e_end FROM k"""),
    "context_features": sql("""SELECT unit_id AS session_id, sample_idx AS epoch_idx, value, round(CASE WHEN value IS NOT NULL AND count(value) OVER a >= 3 THEN avg(value) OVER a END, 6) AS value_mean5, round(CASE WHEN value IS NOT NULL AND count(value) OVER a >= 3 THEN stddev_samp(value) OVER a END, 6) AS value_std5,
round(CASE WHEN value IS NOT NULL AND count(value) OVER b >= 5 THEN avg(value) OVER b END, 6) AS value_mean15, round(value - lag(value, 5) OVER o, 6) AS value_diff5, round(value - lag(value, 15) OVER o, 6) AS value_diff15 FROM trace
WINDOW o AS (PARTITION BY unit_id ORDER BY sample_idx), a AS (PARTITION BY unit_id ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (PARTITION BY unit_id ORDER BY sample_idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)"""),
    "robust_scaled": sql("""s AS (SELECT unit_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM trace GROUP BY 1)
SELECT unit_id AS session_id, sample_idx AS epoch_idx, round((value - m) / CASE WHEN b - a = 0 OR b IS NULL THEN 1 ELSE b - a END, 6) AS value FROM trace JOIN s USING (unit_id)"""),
    "imputed": sql("SELECT unit_id AS session_id, sample_idx AS epoch_idx, round(coalesce(value, m, 0), 6) AS value FROM trace JOIN (SELECT unit_id, quantile_cont(value, 0.5) AS m FROM trace GROUP BY 1) USING (unit_id)"),
    "epoch_statistics": sql("""d AS (SELECT *, sample_idx // 24 AS day FROM trace), v AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY unit_id, day ORDER BY sample_idx)) AS dv FROM d)
SELECT unit_id, day, round(CASE WHEN count(value) >= 12 THEN avg(value) END, 8) AS v_mean, round(CASE WHEN count(value) >= 12 THEN stddev_pop(value) END, 8) AS v_std, round(CASE WHEN count(value) >= 12 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END, 8) AS v_iqr, round(CASE WHEN count(value) >= 12 THEN avg(dv) END, 8) AS v_speed, round(count(value) / 24.0, 8)::DOUBLE AS v_valid FROM v GROUP BY 1, 2"""),
    "bout_activity": sql("""m AS (SELECT unit_id, quantile_cont(value, 0.5) AS m FROM trace GROUP BY 1), l AS (SELECT unit_id, min(m) + 3 * quantile_cont(abs(value - m), 0.5) AS l FROM trace JOIN m USING (unit_id) GROUP BY 1),
u AS (SELECT unit_id, sample_idx // 24 AS day, sample_idx, value > l AS up FROM trace JOIN l USING (unit_id) WHERE value IS NOT NULL), w AS (SELECT *, lag(up) OVER (PARTITION BY unit_id, day ORDER BY sample_idx) AS was FROM u)
SELECT unit_id, day, round(avg(CASE WHEN up THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS active_share, count(*) FILTER (WHERE up AND NOT was) AS crossings FROM w GROUP BY 1, 2"""),
    "balanced_weights": "SELECT vec_id, CAST(label AS VARCHAR) AS label, round((SELECT count(*) FROM embeddings) / (n * 1.0 * (SELECT count(DISTINCT label) FROM embeddings)), 6)::DOUBLE AS weight FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label)",
    "windowed_rates": sql("SELECT CAST(floor(t / 6) * 6 AS BIGINT) AS start_hour, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM e GROUP BY 1, 2"),
    "complete_samples": sql("w AS (SELECT sample_idx, bool_and(value IS NOT NULL) AS ok FROM trace GROUP BY 1) SELECT unit_id, sample_idx, CASE WHEN ok THEN value END AS value FROM trace JOIN w USING (sample_idx)"),
    "long_metrics": "SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR metric IN (l_quantity, l_discount, l_tax))",
    "preferred_labels": "SELECT doc_id, CASE WHEN quality = 1 THEN 'validated' ELSE 'scored' END AS origin FROM labels",
}
