"""Every query with an oracle against DuckDB at the smallest scale; sources and streams round trip."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracetide.operators import pairs as pr
from tracetide.plans import catalog, pair_queries, standins
from tracetide.sources import tables as tb
from tracetide.streaming import refresh as rf

SF = "/root/testdata/sf0.001"


def one(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, bool) or isinstance(x, str):
        return x
    return None if x != x else round(float(x), 6)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(repr, map(one, r))) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    near = lambda x, y: x == y or ("None" not in (x, y) and x[0] in "-0123456789" and abs(float(x) - float(y)) <= 2e-6 * max(1, abs(float(x))))
    assert all(near(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_whole_tables_are_read(spark):
    frames = spark.read.parquet(f"{SF}/customer.parquet").select(F.floor(F.col("c_custkey") / 4)).distinct().count()
    assert catalog.QUERIES["eyelid_openness"](spark, SF).select("frame").distinct().count() == frames
    pairs = catalog.QUERIES["clock_pair_table"](spark, SF.replace("0.001", "0.01"))
    assert {r.u for r in pairs.select(F.explode(F.array("i", "j")).alias("u")).distinct().collect()} == set(range(12))


def test_more_rows_make_more_tasks(spark, monkeypatch):
    sf = SF.replace("0.001", "0.01")
    means = lambda: sorted(catalog.QUERIES["cell_means"](spark, sf).collect())
    whole = means()
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(standins, "ROWS_A_TASK", n // 20, raising=False)
    for df in (standins.suppliers(spark, sf), pair_queries.by_bout(spark, sf)):
        assert df.rdd.getNumPartitions() >= 20
    assert means() == whole


def test_tiles_of_rows_without_a_key(spark):
    rows = spark.createDataFrame([(1, 0), (1, 3), (2, 9), (None, 0), (None, 70)], "rec int, unit_pos long")
    got = pr.tiled(rows, ["rec"], 2).select("rec", "unit_pos", "__ti", "__tj", "__role").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 2), (1, 0, 0, 1, 0), (1, 3, 0, 1, 1), (1, 3, 1, 1, 2), (2, 9, 4, 4, 2)]
    assert {r["__ti"] for r in pr.tiled(rows.where("rec is null").select("unit_pos"), [], 64).collect()} == {0, 1}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_interval_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("start_s,end_s,label\n0,2.5,N\n2.5,4,W\n")
    df = tb.read_intervals(spark, str(tmp_path / "a.csv"))
    tb.write_intervals(df, str(tmp_path / "b"))
    assert sorted(map(tuple, tb.read_intervals(spark, str(tmp_path / "b")).collect())) == [("N", 0.0, 2.5, 2.5), ("W", 2.5, 4.0, 1.5)]
    (tmp_path / "c.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        tb.read_intervals(spark, str(tmp_path / "c.csv"))


def test_trace_partitions(spark, tmp_path):
    df = spark.createDataFrame([("F", 0, 1, 0, 1.0), ("F", 1, 1, 0, float("nan")), ("G", 0, 2, 0, 2.0)], "trace string, channel int, unit_id int, sample_idx int, value double")
    tb.write_trace(df, str(tmp_path / "t"), "v1")
    tb.write_trace(df.where("trace = 'G'").withColumn("value", F.lit(9.0)), str(tmp_path / "t"), "v2")
    got = {(r.trace, r.channel): (r.value, r.source_version) for r in tb.read_trace(spark, str(tmp_path / "t")).collect()}
    assert got == {("F", 0): (1.0, "v1"), ("F", 1): (None, "v1"), ("G", 0): (9.0, "v2")}


def test_refresh_only_builds_what_is_stale(spark, tmp_path):
    wanted = spark.createDataFrame([(1, 2), (2, 1)], "k int, version int")
    built = spark.createDataFrame([(1, 1), (2, 1)], "k int, version int")
    assert rf.refresh(wanted, built, ["k"], lambda d: d.select("k", F.lit(7).alias("x")), str(tmp_path / "o")) == 1
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).select("k", "x", "version").collect()] == [(1, 7, 2)]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = rf.stream_rates(spark, str(tmp_path / "in"), src.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = rf.windowed_rates(src.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "6 hours", "1 hour").select("window.start", "event_type", "n")
    last = src.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = batch.where(F.col("start") + F.expr("interval 7 hours") <= F.lit(last))
    assert closed.exceptAll(got.select("start", "event_type", "n")).count() == 0 and got.count() > 0
