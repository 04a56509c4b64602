"""Long units in blocks of rows: windows with halos, and linear recursions whose memory is carried from block to block.

So a unit is never one group in Python. Rows are numbered without bringing a unit together: counts of coarse cells of
time add up, and rows are numbered inside their cell.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block.
SIZE = 1 << 16


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint, in the folder that the session names in spark.checkpoint.dir; a local session
    without one gets a temporary folder, any other must name one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="tracetide-"))
    return df.checkpoint()


def numbered(trace: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Adds `__rn`, the row's place in its unit by sample_idx from 0, and `__rows`, the unit's rows."""
    at = trace.withColumn("__cell", F.floor(F.col("sample_idx") / size))
    n = at.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = n.select(*keys, "__cell", before.alias("__start"), F.sum("__n").over(w).alias("__rows"))
    own = at.withColumn("__own", F.row_number().over(W.partitionBy(*keys, "__cell").orderBy("sample_idx")) - 1)
    return own.join(start, [*keys, "__cell"]).withColumn("__rn", F.col("__start") + F.col("__own")).drop("__cell", "__own", "__start")


def with_halo(trace: DataFrame, keys: list[str], before: int, after: int, job: Callable[[pa.Table], pa.Table], more: list[T.StructField], size: int = SIZE) -> DataFrame:
    """job(rows in order) -> the same rows with further columns, for each block with the `before` rows ahead of it and the
    `after` rows behind it that the unit has; only the block's own rows stay."""
    first, last = F.greatest(F.lit(0), F.floor((F.col("__rn") - after) / size)), F.least(F.floor((F.col("__rows") - 1) / size), F.floor((F.col("__rn") + before) / size))
    dealt = numbered(trace, keys, size).withColumn("__block", F.explode(F.sequence(first, last))).drop("__rows")
    schema = T.StructType([*trace.schema.fields, *more])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__rn")
        own = pa.compute.equal(pa.compute.floor(pa.compute.divide(rows.column("__rn").cast(pa.float64()), float(size))).cast(pa.int64()), key[-1])
        return job(rows).filter(own).select([f.name for f in schema.fields])

    return dealt.groupBy(*keys, "__block").applyInArrow(run, schema)


@dataclass(frozen=True)
class Recursion:
    """A linear recursion: respond(x, memory) -> (y, memory after), and what one step without input does to the memory."""

    respond: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    step: np.ndarray


def recur(trace: DataFrame, keys: list[str], recursion: Recursion, start: np.ndarray, out: str, backwards: bool = False, size: int = SIZE, on_grid: bool = False) -> DataFrame:
    """Adds `out`: the recursion over `value` (no nulls) along each unit, its first memory being `start` times the first value.
    With `on_grid` no sample_idx is left out, and rows needn't be numbered.

    Each block first tells what memory it leaves from none; a unit's few blocks then hand the memory on, and each block
    runs again from what it is given.
    """
    m, kinds, columns = len(start), {k: trace.schema[k] for k in keys}, trace.columns
    at = trace.withColumn("__rn", F.col("sample_idx")) if on_grid else numbered(trace, keys, size).drop("__rows")
    at = at.withColumn("__block", F.floor(F.col("__rn") / size))
    block = T.StructField("__block", T.LongType())
    order = "descending" if backwards else "ascending"
    memory = T.StructField("__z", T.ArrayType(T.DoubleType()))

    def values(rows: pa.Table) -> np.ndarray:
        return rows.sort_by([("__rn", order)]).column("value").cast(pa.float64()).to_numpy()

    def left(key: tuple, rows: pa.Table) -> pa.Table:
        x = values(rows)
        _, z = recursion.respond(x, np.zeros(m))
        own = {k: pa.array([v.as_py()], v.type) for k, v in zip([*keys, "__block"], key, strict=True)}
        return pa.table(own | {"__len": pa.array([len(x)]), "__first": pa.array([float(x[0])]), "__z": pa.array([z.tolist()])})

    def handed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__block", order)])
        z, given = start * rows.column("__first")[0].as_py(), []
        for n, own in zip(rows.column("__len").to_pylist(), rows.column("__z").to_pylist(), strict=True):
            given.append(z.tolist())
            z = np.linalg.matrix_power(recursion.step, n) @ z + np.array(own)
        return rows.select([*keys, "__block"]).append_column("__z", pa.array(given, pa.list_(pa.float64())))

    sums = at.select(*keys, "__block", "__rn", "value").groupBy(*keys, "__block").applyInArrow(left, T.StructType([*kinds.values(), block, T.StructField("__len", T.LongType()), T.StructField("__first", T.DoubleType()), memory]))
    given = sums.groupBy(*keys).applyInArrow(handed, T.StructType([*kinds.values(), block, memory]))
    schema = T.StructType([*trace.schema.fields, T.StructField(out, T.DoubleType())])

    def whole(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__rn", order)])
        y, _ = recursion.respond(values(rows), np.array(rows.column("__z")[0].as_py()))
        return rows.select(columns).append_column(out, pa.array(y))

    return at.join(given, [*keys, "__block"]).groupBy(*keys, "__block").applyInArrow(whole, schema)
