"""How the provided tables stand in for recordings, as DataFrames and as the same DuckDB expressions.

* trace: events; unit = user_id % 12, sample = hour since the first of January 2024, value = mean;
* states: the commonest event type of each six hours, equal neighbours merged;
* recordings, units, groups, group types: suppliers by ship week, 25 of successive keys to a recording; the suppliers of
  one nation in a recording; regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.operators import intervals as iv

T0, UNITS = 1_704_067_200, 12
#: Units of a recording: more rows make more recordings, so pairs grow with the rows.
PER_RECORDING = 25
#: Rows of lineitem of a task; more rows make more tasks, so none grows with the table.
ROWS_A_TASK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - T0) / 3600)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`unit_id, sample_idx, value` over the full grid of hours; null where a unit has no event."""
    e = timed_events(spark, sf_dir).select((F.col("user_id") % UNITS).alias("unit_id"), F.floor("t").alias("sample_idx"), "value")
    cells = e.groupBy("unit_id", "sample_idx").agg(F.round(F.avg("value"), 3).alias("value"))
    ends = e.groupBy("unit_id").agg(F.lit(1).alias("one")).crossJoin(e.agg(F.min("sample_idx").alias("a"), F.max("sample_idx").alias("b")))
    grid = ends.select("unit_id", F.explode(F.sequence("a", "b")).alias("sample_idx"))
    return grid.join(cells, ["unit_id", "sample_idx"], "left")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`state, start_time, end_time, n_rows` in hours."""
    e = timed_events(spark, sf_dir).select(F.floor(F.col("t") / 6).alias("block"), "event_type")
    n = e.groupBy("block", "event_type").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("block").orderBy(F.desc("n"), "event_type"))
    blocks = n.withColumn("r", first).where("r = 1").select(F.col("event_type").alias("state"), (F.col("block") * 6).alias("start_time"), (F.col("block") * 6 + 6).alias("end_time"))
    return iv.merge_equal(blocks, [])


def user_states(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """The same over users of one parity: two labellings of one time axis."""
    e = timed_events(spark, sf_dir).where(F.col("user_id") % 2 == parity).select(F.floor(F.col("t") / 6).alias("block"), "event_type")
    n = e.groupBy("block", "event_type").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("block").orderBy(F.desc("n"), "event_type"))
    blocks = n.withColumn("r", first).where("r = 1").select(F.col("event_type").alias("state"), (F.col("block") * 6).alias("start_time"), (F.col("block") * 6 + 6).alias("end_time"))
    return iv.merge_equal(blocks, [])


def recording_states(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """`rec, state, start_time, end_time`: the same for five successive users to a recording."""
    e = timed_events(spark, sf_dir).where(F.col("user_id") % 2 == parity).select(F.floor(F.col("user_id") / 5).alias("rec"), F.floor(F.col("t") / 6).alias("block"), "event_type")
    n = e.groupBy("rec", "block", "event_type").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("rec", "block").orderBy(F.desc("n"), "event_type"))
    blocks = n.withColumn("r", first).where("r = 1").select("rec", F.col("event_type").alias("state"), (F.col("block") * 6).alias("start_time"), (F.col("block") * 6 + 6).alias("end_time"))
    return iv.merge_equal(blocks, ["rec"])


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sample_idx, is_valid`: at least eight of the twelve units have a value."""
    return trace(spark, sf_dir).groupBy("sample_idx").agg((F.count("value") >= 8).alias("is_valid"))


def shipped_tasks(spark: SparkSession, sf_dir: str) -> int:
    """So many tasks that each has about `ROWS_A_TASK` rows of lineitem, or one for each core if these are more; the count comes from
    the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // ROWS_A_TASK))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`rec, unit_id, unit_pos, sample_idx, value`: quantity shipped a week by each supplier; weeks without have no row.

    A recording's rows are in one task. Few rows of a task share a supplier and week before that, so none are added up there."""
    l = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_suppkey") / PER_RECORDING).alias("rec"), F.col("l_suppkey").alias("unit_id"), F.floor(F.unix_date(F.col("l_shipdate").cast("date")) / 7).cast("long").alias("sample_idx"), "l_quantity")
    dealt = l.repartition(shipped_tasks(spark, sf_dir), "rec")
    return dealt.groupBy("rec", "unit_id", "sample_idx").agg(F.sum("l_quantity").alias("value")).select("rec", "unit_id", F.col("unit_id").alias("unit_pos"), "sample_idx", "value")


def filled_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all weeks, 0 where nothing was shipped."""
    have = suppliers(spark, sf_dir)
    weeks = have.agg(F.min("sample_idx").alias("a"), F.max("sample_idx").alias("b"))
    every = have.select("rec", "unit_id", "unit_pos").distinct().join(weeks).select("rec", "unit_id", "unit_pos", F.explode(F.sequence("a", "b")).alias("sample_idx"))
    return every.join(have.select("unit_id", "sample_idx", "value"), ["unit_id", "sample_idx"], "left").na.fill(0, ["value"])


def supplier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`unit_id, group_id, group_type`."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("unit_id"), (F.floor(F.col("s_suppkey") / PER_RECORDING) * 25 + F.col("n_nationkey")).alias("group_id"), F.col("n_regionkey").alias("group_type"))


SQL = """
te AS (SELECT event_id, ts, user_id, event_type, value, (epoch_us(ts) / 1e6 - 1704067200) / 3600 AS t FROM events),
e AS (SELECT *, user_id % 12 AS unit_id, CAST(floor(t) AS BIGINT) AS sample_idx FROM te),
cells AS (SELECT unit_id, sample_idx, round(avg(value), 3) AS value FROM e GROUP BY 1, 2),
grid AS (SELECT unit_id, unnest(generate_series(a, b)) AS sample_idx FROM (SELECT DISTINCT unit_id FROM e), (SELECT min(sample_idx) AS a, max(sample_idx) AS b FROM e)),
trace AS (SELECT unit_id, sample_idx, value FROM grid LEFT JOIN cells USING (unit_id, sample_idx)),
mask AS (SELECT sample_idx, count(value) >= 8 AS is_valid FROM trace GROUP BY 1),
cnt AS (SELECT p, CAST(floor(t / 6) AS BIGINT) AS block, event_type, count(*) AS n FROM te, (VALUES (0), (1), (2)) v(p) WHERE p = 2 OR user_id % 2 = p GROUP BY 1, 2, 3),
blk AS (SELECT p, event_type AS state, block * 6 AS s, block * 6 + 6 AS en FROM (SELECT *, row_number() OVER (PARTITION BY p, block ORDER BY n DESC, event_type) AS r FROM cnt) WHERE r = 1),
isl AS (SELECT *, sum(CASE WHEN state = pv THEN 0 ELSE 1 END) OVER (PARTITION BY p ORDER BY s) AS g FROM (SELECT *, lag(state) OVER (PARTITION BY p ORDER BY s) AS pv FROM blk)),
every_states AS (SELECT p, state, min(s) AS start_time, max(en) AS end_time, count(*) AS n_rows FROM isl GROUP BY p, g, state),
states AS (SELECT state, start_time, end_time, n_rows FROM every_states WHERE p = 2),
rcnt AS (SELECT user_id // 5 AS rec, user_id % 2 AS p, CAST(floor(t / 6) AS BIGINT) AS block, event_type, count(*) AS n FROM te GROUP BY 1, 2, 3, 4),
rblk AS (SELECT rec, p, event_type AS state, block * 6 AS s, block * 6 + 6 AS en FROM (SELECT *, row_number() OVER (PARTITION BY rec, p, block ORDER BY n DESC, event_type) AS r FROM rcnt) WHERE r = 1),
risl AS (SELECT *, sum(CASE WHEN state = pv THEN 0 ELSE 1 END) OVER (PARTITION BY rec, p ORDER BY s) AS g FROM (SELECT *, lag(state) OVER (PARTITION BY rec, p ORDER BY s) AS pv FROM rblk)),
rec_states AS (SELECT rec, p, state, min(s) AS start_time, max(en) AS end_time FROM risl GROUP BY rec, p, g, state),
inside AS (SELECT m.sample_idx, m.is_valid, min(st.state) AS state, min(start_time) AS start_time, min(end_time) AS end_time FROM mask m JOIN states st ON m.sample_idx BETWEEN st.start_time AND st.end_time GROUP BY 1, 2 HAVING count(*) = 1),
sup AS (SELECT l_suppkey // 25 AS rec, l_suppkey AS unit_id, l_suppkey AS unit_pos, CAST(floor((CAST(l_shipdate AS DATE) - DATE '1970-01-01') / 7) AS BIGINT) AS sample_idx, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4),
sgrp AS (SELECT s_suppkey AS unit_id, s_suppkey // 25 * 25 + n_nationkey AS group_id, n_regionkey AS group_type FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def sql(query: str) -> str:
    """A query over the stand-ins: the common tables, then `query` (which may open with further ones, ending in SELECT)."""
    return "WITH" + SQL.rstrip() + (",\n" if not query.lstrip().upper().startswith("SELECT") else "\n") + query
