"""Readers and writers of recordings as tables. Readers turn NaN into null and prune by partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tracetide.functions.rules import group_id, layer, standard_label
from tracetide.operators.intervals import from_nan
from tracetide.operators.scoring import ALIASES

#: The two accepted forms of state-interval files.
TIMED, READY = ["start_s", "end_s", "label"], ["state", "start_time", "end_time", "duration"]


def read_trace(spark: SparkSession, path: str, trace: str | None = None, units: list | None = None, channel: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Traces, pruned by the partition columns `trace` and `channel` and filtered by unit before anything else."""
    df = spark.read.parquet(path)
    if trace is not None:
        df = df.where(F.col("trace") == trace)
    if channel is not None:
        df = df.where(F.col("channel") == channel)
    if units is not None:
        df = df.where(F.col("unit_id").isin(units))
    df = from_nan(df, *[f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))])
    return df if groups is None else df.join(groups, "unit_id", "left")


def write_trace(df: DataFrame, path: str, version: str, keys: list[str] | None = None) -> None:
    """Writes partitions of the keys, replacing only those in the data, each row with the source's version."""
    out = df.withColumn("source_version", F.lit(version))
    out.repartition(*(keys or ["trace", "channel"])).sortWithinPartitions("unit_id", "sample_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(keys or ["trace", "channel"])).parquet(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """State intervals from CSV in either form; an error names the columns found."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if set(TIMED) <= set(df.columns):
        df = df.withColumnsRenamed({"label": "state", "start_s": "start_time", "end_s": "end_time"})
    elif not set(READY) <= set(df.columns):
        raise ValueError(f"columns are {df.columns}")
    num = df.withColumns({c: F.col(c).cast("double") for c in ("start_time", "end_time")})
    return num.withColumn("duration", F.col("end_time") - F.col("start_time")).select(*READY)


def read_labels(spark: SparkSession, path: str, drop_artifact: bool = False, strict: bool = True) -> DataFrame:
    """`label, raw_label, l_start, l_end` from an interval CSV, labels under their standard names and checked.

    Intervals must have both ends in order; with `strict` an unknown label is an error when the rows are read, else
    such rows are left out.
    """
    raw = read_intervals(spark, path).select(F.col("state").alias("label"), F.col("start_time").alias("l_start"), F.col("end_time").alias("l_end"))
    rows = raw.withColumn("raw_label", F.col("label")).withColumn("label", standard_label(F.col("raw_label"), ALIASES))
    if drop_artifact:
        rows = rows.where(F.coalesce(F.upper(F.trim("raw_label")), F.lit("")) != "ARTIFACT")
    wrong = F.col("l_start").isNull() | F.col("l_end").isNull() | (F.col("l_end") <= F.col("l_start"))
    unknown = F.lit(strict) & F.col("label").isNull()
    told = F.when(wrong, F.raise_error(F.lit("an interval without ends in order"))).when(unknown, F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("raw_label", F.lit("(none)")))))
    return rows.withColumn("label", F.coalesce(told.cast("string"), "label")).where("label is not null").select("label", "raw_label", "l_start", "l_end")


def write_intervals(df: DataFrame, path: str) -> None:
    df.select(*READY).write.mode("overwrite").csv(path, header=True)


def prefer(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per key, the rows of the first table that has any."""
    every = reduce(lambda a, b: a.unionByName(b), [t.withColumn("priority", F.lit(k)) for k, t in enumerate(tables)])
    best = every.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return every.join(best, [*keys, "priority"], "left_semi")


def unit_labels(label_tables: list[DataFrame], soma_depths: DataFrame, nulls: str | None = None) -> DataFrame:
    """The unit table: label tables together, the master image left out, ids normalised, depth and layer joined."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), label_tables).where("source_id is null or source_id <> 'master_image'")
    out = every.withColumn("group_id", group_id(F.col("group_id"))).join(soma_depths.withColumnRenamed("depth", "__d"), "owner_id", "left")
    out = out.withColumn("owner_depth", F.coalesce("__d", "owner_depth")).drop("__d").withColumn("layer", layer(F.col("owner_depth")))
    return out if nulls is None else out.na.fill(nulls)


def to_long(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each key and metric."""
    return wide.unpivot(keys, metrics, "metric", "value")


def pose_table(raw: DataFrame, parts: list[str]) -> DataFrame:
    """Wide pose columns `part__x, part__y, part__likelihood` to one row a frame and body part; frames must be numbers."""
    ok = raw.withColumn("frame", F.expr("try_cast(frame as bigint)")).where("frame is not null")
    return reduce(lambda a, b: a.unionByName(b), [ok.select("frame", F.lit(p).alias("part"), *[F.expr(f"try_cast(`{p}__{c}` as double)").alias(c) for c in ("x", "y", "likelihood")]) for p in parts])


def trimmed(df: DataFrame, bounds: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows within their key's bounds; missing bounds are open."""
    at = df.join(bounds, keys, "left")
    return at.where((F.col(time) >= F.coalesce("t0", F.lit(float("-inf")))) & (F.col(time) <= F.coalesce("t1", F.lit(float("inf"))))).drop("t0", "t1")


def masked_labels(epochs: DataFrame, states: list[str], threshold: float) -> DataFrame:
    """Epoch labels, 'unclear' where no state's probability reaches the threshold."""
    top: Column = F.greatest(*[F.col(f"P_{s}") for s in states])
    return epochs.withColumn("label", F.when(top < threshold, "unclear").otherwise(F.col("label")))


def complete_only(trace: DataFrame, keys: list[str]) -> DataFrame:
    """A sample missing in one unit becomes missing in all."""
    whole = trace.groupBy(*keys, "sample_idx").agg(F.bool_and(F.col("value").isNotNull()).alias("__ok"))
    return trace.join(whole, [*keys, "sample_idx"]).withColumn("value", F.when(F.col("__ok"), F.col("value"))).drop("__ok")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit table from CSV, all text, with the two tests of freshness and completeness."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.withColumns({"is_fresh": F.lower(F.trim("status")) == "fresh", "is_complete": F.lower(F.trim("scoring_complete")).isin("true", "1", "yes")})
