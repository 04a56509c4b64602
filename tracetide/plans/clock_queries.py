"""Clocks, audits, geometry and scalar rules: queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracetide.functions import rules
from tracetide.operators import clock as ck
from tracetide.operators import geometry as ge
from tracetide.operators import intervals as iv
from tracetide.plans import standins as st
from tracetide.plans.signal_queries import rounded
from tracetide.plans.standins import sql, table


def kind(spark, d, name):
    return st.timed_events(spark, d).where(F.col("event_type") == name).select("user_id", F.round("t", 6).alias("t"), "event_id", "value")


def last_signup(spark, d):
    return ck.as_of(kind(spark, d, "purchase").select("user_id", "t", "event_id"), kind(spark, d, "signup").select("user_id", "t", F.col("event_id").alias("v")), ["user_id"], "t", "v").select("event_id", "user_id", F.col("match").alias("signup_id"))


def nearest_view(spark, d):
    return ck.nearest(kind(spark, d, "purchase").select("user_id", "t", "event_id"), kind(spark, d, "view").select("user_id", "t", F.col("event_id").alias("v")), ["user_id"], "t", "v", 24.0).select("event_id", "user_id", F.col("match").alias("view_id"))


def event_blocks(spark, d):
    b = st.states(spark, d).select((F.col("start_time") / 6).cast("long").alias("block_id"), (F.col("start_time") + 1).alias("start_time"), F.col("end_time"))
    return ck.assign_blocks(kind(spark, d, "error").select("event_id", "t"), b, "t", 24.0).select("event_id", "block_id", "status")


def clock_lookup(spark, d):
    """Hours spent in each event's state so far, looked up as of the hour."""
    inside = iv.samples_in_states(st.trace(spark, d).select("sample_idx").distinct(), st.states(spark, d), closed="left").withColumn("one", F.lit(1))
    from pyspark.sql import Window as W

    run = inside.withColumn("clock", F.sum("one").over(W.partitionBy("state").orderBy("sample_idx")))
    return run.select("sample_idx", "state", "clock")


def document_freshness(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    expected = docs.select("doc_id", F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("output")).withColumn("version", F.lit(1))
    present = labels.select("doc_id", F.lit("quality").alias("output"), F.col("quality").alias("version")).unionByName(labels.select("doc_id", F.lit("toxic").alias("output"), (1 - F.col("toxic")).alias("version")))
    return ck.freshness(expected, present, ["doc_id"])


def readiness(spark, d):
    docs, labels, pages = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "pages")
    return ck.ready(docs, {"labelled": labels, "paged": pages.select(F.col("page_id").alias("doc_id")), "long": docs.where("n_chars > 500")}, ["doc_id"])


def overall(spark, d):
    labels = table(spark, d, "labels")
    parts = labels.select("doc_id", F.lit(1).alias("position"), F.lit("quality").alias("component"), F.when(F.col("quality") == 1, "fresh").otherwise("stale").alias("status")).unionByName(labels.select("doc_id", F.lit(2).alias("position"), F.lit("toxic").alias("component"), F.when(F.col("toxic") == 1, "missing").otherwise("fresh").alias("status")))
    return ck.worst_status(parts, ["doc_id"], ["fresh", "stale", "missing"])


def circles(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 1).alias("w"))
    return rounded(ge.fit_circles(p, ["l_orderkey"], 5), "cx", "cy", "diameter", n=4)


def along(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("line"), F.col("c_custkey").alias("point"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 90).cast("double").alias("y"))
    v = table(spark, d, "supplier").select(F.col("s_nationkey").alias("line"), F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 80).cast("double").alias("y"))
    return rounded(ge.arc_length(c, v, "line", "point"), "arc", "off")


def event_groups(spark, d):
    """Suppliers with deliveries as units, nations of a recording as groups, regions as owners."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit_id")).join(st.supplier_groups(spark, d), "unit_id")
    tree = ck.event_tree(e.withColumns({"dmd": F.col("group_type"), "owner_depth": (F.col("group_id") % 3 - 1).cast("double")}), owner="group_type")
    return tree.select("group_type", "group_id", "n_units", F.array_join(F.col("depths").cast("array<int>"), ",").alias("depths"))


def trials(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderkey").agg(F.round(F.max("o_totalprice") / 1000).cast("long").alias("n_frames"))
    return ge.select_trials(ge.trial_table(o.withColumnsRenamed({"o_orderkey": "trial"}), ["o_custkey"], 200.0), 1.0, 3.0, 200.0)


QUERIES = {
    "as_of_signup": last_signup,
    "nearest_view": nearest_view,
    "event_blocks": event_blocks,
    "state_clock_lookup": clock_lookup,
    "first_crossing": lambda s, d: ck.first_crossing(st.suppliers(s, d).withColumn("sample_idx", F.col("sample_idx") - 1450).where("value is not null"), ["unit_id"], 20, 1.2),
    "pulses": lambda s, d: ck.pulses(st.trace(s, d).na.fill(0.0, ["value"]), ["unit_id"], 3.0, 5),
    "reconciled_pulses": lambda s, d: ck.reconcile_pulses(ck.pulses(st.trace(s, d).na.fill(0.0, ["value"]), ["unit_id"], 3.0, 5), st.trace(s, d).groupBy("unit_id").agg(F.lit(60).alias("n_frames")), ["unit_id"]),
    "document_freshness": document_freshness,
    "document_readiness": readiness,
    "overall_status": overall,
    "id_differences": lambda s, d: ck.id_differences(table(s, d, "documents").select("source", "doc_id"), table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("source", "doc_id"), ["source"], "doc_id"),
    "to_rebuild": lambda s, d: ck.to_rebuild(table(s, d, "documents").select("doc_id", F.lit(1).alias("version")), table(s, d, "labels").select("doc_id", F.col("quality").alias("version")), ["doc_id"]),
    "upserted_depths": lambda s, d: ck.upsert(table(s, d, "labels").withColumn("depth", F.col("quality").cast("double")), table(s, d, "documents"), ["doc_id"], "depth", -1.0),
    "clock_kind": lambda s, d: ck.clock_of(st.timed_events(s, d), ["user_id"], "t", F.lit(715.0), F.lit(1.0)).select("user_id", "clock"),
    "event_groups": event_groups,
    "repeated_owners": lambda s, d: ck.repeated_owners(table(s, d, "customer"), "c_mktsegment", "c_nationkey"),
    "circle_fits": circles,
    "arc_lengths": along,
    "unit_centroids": lambda s, d: rounded(ge.centroids(table(s, d, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("y")), ["c_nationkey"]), "cx", "cy"),
    "unit_boxes": lambda s, d: ge.bounding_box(table(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("x"), (F.col("c_custkey") % 97).alias("y"), F.col("c_acctbal").alias("value")), ["c_nationkey"], 2),
    "ordered_units": lambda s, d: ge.order_along(table(s, d, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("arc")), ["s_nationkey"], "arc", "s_suppkey"),
    "trial_slices": trials,
    "even_sample": lambda s, d: ge.evenly_spaced(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100),
    "scalar_rules": lambda s, d: table(s, d, "pages").select("page_id", rules.path_part(F.col("url")).alias("part"), rules.natural_key(F.regexp_extract("url", r"/(\w+/\d+)", 1)).alias("natural"), rules.layer((F.col("page_id") % 1000).cast("double")).alias("layer"), rules.group_id(F.concat(F.lit("b"), (F.col("page_id") % 7).cast("string"))).alias("grp"), rules.pair_key(F.col("page_id"), F.col("page_id") * 3 % 100).alias("pair")),
}

EDGES = """d AS (SELECT unit_id, sample_idx, coalesce(value, 0) - lag(coalesce(value, 0)) OVER (PARTITION BY unit_id ORDER BY sample_idx) AS d FROM trace), g AS (SELECT *, max(d) OVER (PARTITION BY unit_id) AS top FROM d),
h AS (SELECT *, lag(sample_idx) OVER (PARTITION BY unit_id ORDER BY sample_idx) AS p FROM g WHERE d > top / 3), k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY sample_idx) AS n FROM h WHERE p IS NULL OR sample_idx - p >= 5)"""

ORACLES = {
    "as_of_signup": sql("SELECT p.event_id, p.user_id, s.event_id AS signup_id FROM (SELECT *, round(t, 6) AS tt FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT *, round(t, 6) AS tt FROM e WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.tt >= s.tt"),
    "nearest_view": sql("""c AS (SELECT p.event_id, p.user_id, v.event_id AS view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(round(v.t, 6) - round(p.t, 6)), v.t) AS r FROM e p LEFT JOIN e v ON p.user_id = v.user_id AND v.event_type = 'view' AND abs(round(v.t, 6) - round(p.t, 6)) <= 24 WHERE p.event_type = 'purchase')
SELECT event_id, user_id, view_id FROM c WHERE r = 1"""),
    "event_blocks": sql("SELECT event_id, min(start_time // 6) AS block_id, CASE WHEN min(start_time // 6) IS NULL THEN 'no_block' ELSE 'ok' END AS status FROM e LEFT JOIN states s ON round(t, 6) BETWEEN s.start_time + 1 AND s.end_time WHERE event_type = 'error' GROUP BY 1"),
    "state_clock_lookup": sql("SELECT sample_idx, state, count(*) OVER (PARTITION BY state ORDER BY sample_idx) AS clock FROM (SELECT DISTINCT sample_idx FROM trace) JOIN states ON sample_idx >= start_time AND sample_idx < end_time"),
    "first_crossing": sql("s AS (SELECT unit_id, sample_idx - 1450 AS i, value FROM sup), l AS (SELECT unit_id, max(value) AS top FROM s WHERE i < 20 GROUP BY 1) SELECT unit_id, min(CASE WHEN value > top * 1.2 THEN i END) AS start_sample FROM s JOIN l USING (unit_id) GROUP BY 1"),
    "pulses": sql(EDGES + "SELECT unit_id, sample_idx + 1 AS pulse, CAST(n - 2 AS INT) AS frame FROM k WHERE n > 1"),
    "reconciled_pulses": sql(EDGES + """, pu AS (SELECT unit_id, sample_idx + 1 AS pulse, n - 2 AS frame FROM k WHERE n > 1), s AS (SELECT unit_id, count(*) AS have, min(pulse) AS a, max(pulse) AS b FROM pu GROUP BY 1),
more AS (SELECT *, unnest(range(1, 60 - have + 1)) AS i FROM s WHERE have < 60)
SELECT unit_id, pulse::DOUBLE AS pulse, frame::BIGINT AS frame FROM pu WHERE frame < 60 UNION ALL SELECT unit_id, CASE WHEN have > 1 THEN b + i * ((b - a) / (have - 1)) END, have + i - 1 FROM more"""),
    "scalar_rules": r"""SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g') AS part,
  array_to_string(list_transform(regexp_extract_all(regexp_extract(url, '/(\w+/\d+)', 1), '\d+|\D+'), lambda p: CASE WHEN regexp_full_match(p, '\d+') THEN lpad(p, 12, '0') ELSE lower(p) END), '') AS natural,
  CASE WHEN page_id % 1000 < 0 THEN NULL WHEN page_id % 1000 < 100 THEN 'L1' WHEN page_id % 1000 < 300 THEN 'L2/3' WHEN page_id % 1000 < 500 THEN 'L4' WHEN page_id % 1000 < 800 THEN 'L5' ELSE 'L6' END AS layer,
  'B-' || page_id % 7 AS grp, array_to_string(list_sort([CAST(page_id AS VARCHAR), CAST(page_id * 3 % 100 AS VARCHAR)]), '+') AS pair FROM pages""",
    "circle_fits": """WITH p AS (SELECT l_orderkey, l_quantity::DOUBLE AS x, l_discount * 100::DOUBLE AS y, l_tax * 100::DOUBLE + 1 AS w FROM lineitem), m AS (SELECT *, avg(x) OVER g AS mx, avg(y) OVER g AS my FROM p WINDOW g AS (PARTITION BY l_orderkey)),
t AS (SELECT *, x - mx AS u, y - my AS v, (x - mx) * (x - mx) + (y - my) * (y - my) AS z FROM m),
s AS (SELECT l_orderkey, count(*) AS n, min(mx) AS mx, min(my) AS my, sum(w) AS sw, sum(w * u) AS su, sum(w * v) AS sv, sum(w * u * u) AS suu, sum(w * u * v) AS suv, sum(w * v * v) AS svv, sum(w * u * z) AS suz, sum(w * v * z) AS svz, sum(w * z) AS sz FROM t GROUP BY 1),
d AS (SELECT *, suu * (svv * sw - sv * sv) - suv * (suv * sw - sv * su) + su * (suv * sv - svv * su) AS det FROM s),
f AS (SELECT *, CASE WHEN n >= 5 AND abs(det) > 1e-9 THEN (suz * (svv * sw - sv * sv) - suv * (svz * sw - sv * sz) + su * (svz * sv - svv * sz)) / det END AS a,
  CASE WHEN n >= 5 AND abs(det) > 1e-9 THEN (suu * (svz * sw - sv * sz) - suz * (suv * sw - sv * su) + su * (suv * sz - svz * su)) / det END AS b,
  CASE WHEN n >= 5 AND abs(det) > 1e-9 THEN (suu * (svv * sz - svz * sv) - suv * (suv * sz - svz * su) + suz * (suv * sv - svv * su)) / det END AS c FROM d)
SELECT l_orderkey, n, round(mx + a / 2, 4) AS cx, round(my + b / 2, 4) AS cy, round(CASE WHEN a IS NOT NULL THEN 2 * sqrt(greatest(0.0, c + (a * a + b * b) / 4)) END, 4) AS diameter FROM f""",
    "document_freshness": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_applicable' WHEN quality <> 1 OR 1 - toxic <> 1 THEN 'stale' ELSE 'fresh' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "document_readiness": """SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, p.page_id IS NOT NULL AS paged, n_chars > 500 AS long, l.doc_id IS NOT NULL AND p.page_id IS NOT NULL AND n_chars > 500 AS ready FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id""",
    "overall_status": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'missing' WHEN quality = 0 THEN 'stale' ELSE 'fresh' END AS overall, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'quality' END AS component FROM labels",
    "id_differences": "SELECT source, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_unexpected, min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS first_missing, CAST(NULL AS BIGINT) AS first_unexpected, CASE WHEN count(*) FILTER (WHERE l.doc_id IS NULL) = 0 THEN 'ok' ELSE 'mismatch' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    "to_rebuild": "SELECT doc_id, CAST(1 AS INT) AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "upserted_depths": "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), -1.0)::DOUBLE AS depth FROM documents FULL JOIN labels USING (doc_id)",
    "clock_kind": sql("SELECT user_id, CASE WHEN a >= 0 AND b <= 715 AND a >= 1 AND b <= 716 THEN 'ambiguous' WHEN a >= 0 AND b <= 715 THEN 'trial' WHEN a >= 1 AND b <= 716 THEN 'block' ELSE 'ambiguous' END AS clock FROM (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY 1)"),
    "event_groups": sql("""ev AS (SELECT group_type, group_id, unit_id, CAST(group_id % 3 - 1 AS INT) AS depth FROM (SELECT DISTINCT l_suppkey AS unit_id FROM lineitem) JOIN sgrp USING (unit_id))
SELECT group_type, group_id, count(DISTINCT unit_id) AS n_units, coalesce(array_to_string(list_sort(list(DISTINCT depth) FILTER (WHERE depth <> -1)), ','), '') AS depths FROM ev GROUP BY 1, 2"""),
    "repeated_owners": "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1",
    "unit_centroids": "SELECT c_nationkey, round(avg(c_acctbal), 6) AS cx, round(avg(c_custkey), 6) AS cy, count(*) AS n FROM customer GROUP BY 1",
    "unit_boxes": "SELECT c_nationkey, min(c_custkey) - 2 AS x0, max(c_custkey) + 2 AS x1, min(c_custkey % 97) - 2 AS y0, max(c_custkey % 97) + 2 AS y1 FROM customer GROUP BY 1",
    "ordered_units": "SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS arc, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN s_acctbal END ASC NULLS LAST, s_suppkey) - 1 AS INT) AS pos FROM supplier",
    "arc_lengths": """WITH v AS (SELECT s_nationkey AS line, s_suppkey AS pos, s_acctbal / 100 AS x, CAST(s_suppkey % 80 AS DOUBLE) AS y FROM supplier), g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY line ORDER BY pos)),
s AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len FROM g WHERE x2 IS NOT NULL), b AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY pos) - len AS bef FROM s),
p AS (SELECT c_nationkey AS line, c_custkey AS point, c_acctbal / 100 AS px, CAST(c_custkey % 90 AS DOUBLE) AS py FROM customer),
t AS (SELECT *, greatest(0.0, least(1.0, coalesce(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / nullif((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y), 0), 0.0))) AS t FROM p JOIN b USING (line)),
d AS (SELECT *, round(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2), 9) AS d2 FROM t)
SELECT line, point, round(first(bef + t * len ORDER BY d2, pos), 6) AS arc, round(sqrt(min(d2)), 6) AS off FROM d GROUP BY 1, 2""",
    "trial_slices": """WITH o AS (SELECT o_custkey, o_orderkey AS trial, CAST(round(max(o_totalprice) / 1000) AS BIGINT) AS n_frames FROM orders GROUP BY 1, 2), n AS (SELECT *, CAST(round(n_frames * 200.0 / 80.0) AS BIGINT) AS n_samples FROM o),
c AS (SELECT *, CAST(sum(n_samples) OVER (PARTITION BY o_custkey ORDER BY trial) AS BIGINT) AS last_sample FROM n), f AS (SELECT *, last_sample - n_samples AS first_sample, greatest(last_sample - n_samples, 200) AS slice_start, least(last_sample, 600) AS slice_end FROM c)
SELECT * FROM f WHERE slice_end > slice_start""",
    "even_sample": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r IN (SELECT CAST(floor((k + 0.5) * (SELECT count(*) FROM orders) / 100) AS BIGINT) FROM range(100) t(k))",
}
