"""Validity masks, state intervals and tilings, by sample index and window expressions.

Samples are integers; an interval has `state, start_time, end_time` in the same unit. Missing values are null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_nan(df: DataFrame, *cols: str) -> DataFrame:
    """NaN becomes null; every reader passes through here."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in cols})


def validity_mask(trace: DataFrame, keys: list[str], mode: str = "all") -> DataFrame:
    """`keys, sample_idx, is_valid`: whether all, or any, units have a value at a sample."""
    if mode == "per_unit":
        return trace.withColumn("is_valid", F.col("value").isNotNull())
    have = {"all": F.bool_and, "any": F.bool_or}[mode]
    return trace.groupBy(*keys, "sample_idx").agg(have(F.col("value").isNotNull()).alias("is_valid"))


def sample_step(samples: DataFrame, keys: list[str], time: str = "sample_idx") -> DataFrame:
    """`keys, dt, fs`: the median difference of successive times; null below two samples."""
    at = samples.select(*keys, time).distinct()
    diff = at.withColumn("d", F.col(time) - F.lag(time).over(W.partitionBy(*keys).orderBy(time)))
    out = diff.groupBy(*keys).agg(F.percentile("d", F.lit(0.5)).alias("dt"))
    return out.withColumn("dt", F.when(F.col("dt") > 0, F.col("dt"))).withColumn("fs", F.try_divide(F.lit(1.0), F.col("dt")))


def runs(df: DataFrame, keys: list[str], flag: Column | str, order: str = "sample_idx") -> DataFrame:
    """Rows where the flag holds, with `run`, the same for rows that follow one another by index."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.where(flag).withColumn("run", F.col(order) - F.row_number().over(w))


def valid_intervals(mask: DataFrame, keys: list[str], dt: float = 1.0) -> DataFrame:
    """Maximal runs of valid samples: first and last sample and seconds."""
    return runs(mask, keys, "is_valid").groupBy(*keys, "run").agg(F.min("sample_idx").alias("start_time"), F.max("sample_idx").alias("end_time"), (F.count(F.lit(1)) * F.lit(dt)).alias("duration")).drop("run")


def valid_duration(mask: DataFrame, keys: list[str], t1: float | None = None, t2: float | None = None, dt: float = 1.0) -> DataFrame:
    """Seconds of valid samples within [t1, t2], open where a bound is missing."""
    ok = F.col("is_valid")
    if t1 is not None:
        ok &= F.col("sample_idx") >= t1
    if t2 is not None:
        ok &= F.col("sample_idx") <= t2
    return mask.groupBy(*keys).agg((F.count_if(ok) * F.lit(dt)).alias("valid_s"))


def merge_equal(rows: DataFrame, keys: list[str], label: str = "state", start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Adjacent rows with one label become one, from the first start to the last end."""
    w = W.partitionBy(*keys).orderBy(start)
    island = F.sum((~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(start).over(w).isNull()).cast("int")).over(w)
    return rows.withColumn("__island", island).groupBy(*keys, "__island", label).agg(F.min(start).alias(start), F.max_by(end, start).alias(end), F.count(F.lit(1)).alias("n_rows")).drop("__island")


def samples_in_states(samples: DataFrame, intervals: DataFrame, keys: list[str] | None = None, closed: str = "both", bucket: int = 24) -> DataFrame:
    """Joins samples with the interval they lie in: adds `state, start_time, end_time`.

    `closed` is "both" (a sample on the edge of two intervals belongs to neither) or "left". Intervals are
    exploded over buckets of time, so the join has an equality to hash by.
    """
    keys = keys or []
    cells = F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket)))
    cut = intervals.select(*keys, "state", "start_time", "end_time").withColumn("__cell", cells)
    inside = (F.col("sample_idx") >= F.col("start_time")) & (F.col("sample_idx") <= F.col("end_time") if closed == "both" else F.col("sample_idx") < F.col("end_time"))
    out = samples.withColumn("__cell", F.floor(F.col("sample_idx") / bucket)).join(cut, [*keys, "__cell"]).where(inside).drop("__cell")
    if closed == "left":
        return out
    own = [c for c in samples.columns if c != "value"]
    return out.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*own))).where("__n = 1").drop("__n")


def state_valid_runs(mask: DataFrame, intervals: DataFrame, states: list[str], keys: list[str] | None = None, dt: float = 1.0) -> DataFrame:
    """Maximal runs of samples that are valid and in any of the states; the label joins their names."""
    keys = keys or []
    inside = samples_in_states(mask.where("is_valid"), intervals.where(F.col("state").isin(states)), keys)
    return runs(inside, keys, F.lit(True)).groupBy(*keys, "run").agg(F.min("sample_idx").alias("start_time"), F.max("sample_idx").alias("end_time"), (F.count(F.lit(1)) * F.lit(dt)).alias("duration")).drop("run").withColumn("state", F.lit("|".join(states)))


def tile_strict(mask: DataFrame, intervals: DataFrame, state: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """Epochs of n samples, end to end inside each valid run; what is left over is dropped."""
    keys = keys or []
    inside = runs(samples_in_states(mask.where("is_valid"), intervals.where(F.col("state") == state), keys), keys, F.lit(True))
    k = F.floor((F.row_number().over(W.partitionBy(*keys, "run").orderBy("sample_idx")) - 1) / n)
    tiles = inside.withColumn("k", k).groupBy(*keys, "run", "k").agg(F.min("sample_idx").alias("start_time"), F.max("sample_idx").alias("end_time"), F.count(F.lit(1)).alias("valid"))
    return tiles.where(F.col("valid") == n).drop("run", "k").withColumn("state", F.lit(state)).withColumn("wall", F.col("end_time") - F.col("start_time") + 1)


def tile_span(mask: DataFrame, intervals: DataFrame, state: str, n: int, max_gap: int | None = None, min_bout: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Epochs of exactly n valid samples of one state run that may hold gaps of up to `max_gap` samples.

    A longer gap starts anew and what was begun is dropped. Closed form: split the state run at long gaps,
    rank the valid samples of a part, and divide the rank by n.
    """
    keys = keys or []
    inside = runs(samples_in_states(mask, intervals.where(F.col("state") == state), keys), keys, F.lit(True)).withColumnRenamed("run", "bout")
    inside = inside.withColumn("__size", F.count(F.lit(1)).over(W.partitionBy(*keys, "bout"))).where(F.col("__size") >= min_bout).where("is_valid")
    w = W.partitionBy(*keys, "bout").orderBy("sample_idx")
    gap = F.col("sample_idx") - F.lag("sample_idx").over(w) - 1
    part = F.sum(F.coalesce(gap > F.lit(max_gap), F.lit(False)).cast("int")).over(w) if max_gap is not None else F.lit(0)
    ranked = inside.withColumn("part", part).withColumn("k", F.floor((F.row_number().over(W.partitionBy(*keys, "bout", "part").orderBy("sample_idx")) - 1) / n))
    tiles = ranked.groupBy(*keys, "bout", "part", "k").agg(F.min("sample_idx").alias("start_time"), F.max("sample_idx").alias("end_time"), F.count(F.lit(1)).alias("valid"))
    return tiles.where(F.col("valid") == n).drop("bout", "part", "k").withColumn("state", F.lit(state)).withColumn("wall", F.col("end_time") - F.col("start_time") + 1)


def sample_rows(rows: DataFrame, n: int, seed: int, order: str = "start_time") -> DataFrame:
    """A seeded uniform subset of n rows in order; all rows if there are no more."""
    rank = F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), order), order))
    return rows.orderBy(F.xxhash64(F.lit(seed), order), order).limit(n).withColumn("draw", rank)


def state_bouts(mask: DataFrame, intervals: DataFrame, keys: list[str] | None = None, dt: float = 1.0, min_valid: float = 0.0) -> DataFrame:
    """One row an interval with its index, valid seconds (both ends in) and wall seconds."""
    keys = keys or []
    own = intervals.withColumn("bout_idx", F.row_number().over(W.partitionBy(*keys).orderBy("start_time")) - 1)
    hits = samples_in_states(mask.where("is_valid"), intervals, keys).groupBy(*keys, "start_time").agg((F.count(F.lit(1)) * F.lit(dt)).alias("valid_duration"))
    out = own.join(hits, [*keys, "start_time"], "left").withColumn("valid_duration", F.coalesce("valid_duration", F.lit(0.0)))
    return out.withColumn("wall_duration", F.col("end_time") - F.col("start_time")).where(F.col("valid_duration") >= min_valid)


def bout_context(bouts: DataFrame, keys: list[str] | None = None, duration: str = "valid_duration") -> DataFrame:
    """Per state: index, time in state before and after each bout, gap to the bout before (null for the first)."""
    w = W.partitionBy(*(keys or []), "state").orderBy("start_time")
    run = F.sum(duration).over(w.rowsBetween(W.unboundedPreceding, 0))
    return bouts.withColumns({"state_idx": F.row_number().over(w) - 1, "clock_start": run - F.col(duration), "clock_end": run, "gap": (F.col("start_time") - F.lag("end_time").over(w)).cast("double")})


def state_clock_bins(bouts: DataFrame, window: float, keys: list[str] | None = None) -> DataFrame:
    """Cuts time in state into bins of `window`, and each bout, in proportion, into wall-clock slices."""
    at = bout_context(bouts, keys, "wall_duration").where("clock_end > clock_start")
    bins = at.withColumn("bin", F.explode(F.sequence(F.floor(F.col("clock_start") / window), F.floor((F.col("clock_end") - 1e-12) / window))))
    lo, hi = F.greatest("clock_start", F.col("bin") * window), F.least("clock_end", (F.col("bin") + 1) * window)
    rate = (F.col("end_time") - F.col("start_time")) / (F.col("clock_end") - F.col("clock_start"))
    return bins.withColumns({"slice_start": F.col("start_time") + (lo - F.col("clock_start")) * rate, "slice_end": F.col("start_time") + (hi - F.col("clock_start")) * rate})


def split_periods(bouts: DataFrame, n: int = 3, labels: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Labels a bout by the equal-width period its midpoint falls in; the last edge counts as inside."""
    w = W.partitionBy(*(keys or []))
    t0, t1 = F.min("start_time").over(w), F.max("end_time").over(w)
    k = F.least(F.floor(((F.col("start_time") + F.col("end_time")) / 2 - t0) / ((t1 - t0) / n)), F.lit(n - 1))
    labels = labels or (["early", "middle", "late"] if n == 3 else [str(i) for i in range(n)])
    return bouts.withColumn("period", F.element_at(F.array(*[F.lit(x) for x in labels]), (k + 1).cast("int")))


def state_coverage(intervals: DataFrame, t0: Column, t1: Column, keys: list[str] | None = None) -> DataFrame:
    """Seconds and share of each state within [t0, t1]."""
    cut = intervals.withColumn("s", F.greatest(F.least("end_time", t1) - F.greatest("start_time", t0), F.lit(0.0)))
    out = cut.groupBy(*(keys or []), "state").agg(F.sum("s").alias("seconds"))
    return out.withColumn("share", F.try_divide(F.col("seconds"), (t1 - t0)))


def recording_coverage(intervals: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds and share of each state within each recording's own `bounds(keys, t0, t1)`; states that lie outside have 0."""
    at = intervals.join(bounds, keys)
    inside = F.greatest(F.least("end_time", "t1") - F.greatest("start_time", "t0"), F.lit(0.0))
    out = at.groupBy(*keys, "state").agg(F.sum(inside).alias("seconds"), F.first(F.col("t1") - F.col("t0")).alias("__whole"))
    return out.withColumn("share", F.try_divide(F.col("seconds"), F.col("__whole").cast("double"))).drop("__whole")


def overlap_labels(epochs: DataFrame, labels: DataFrame, min_share: float = 0.0, keys: list[str] | None = None, bucket: int = 24) -> DataFrame:
    """Gives each epoch the label it overlaps longest, if more than `min_share` of it; ties to the earliest label.

    epochs: `keys, epoch_idx, e_start, e_end`; labels: `keys, label, l_start, l_end`; both half open, and exploded
    over buckets of time for an equality to hash by.
    """
    keys = keys or []
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    own = epochs.select(*keys, "epoch_idx", "e_start", "e_end").withColumn("__c", cell("e_start", "e_end"))
    cut = labels.select(*keys, "label", "l_start", "l_end").withColumn("__c", cell("l_start", "l_end"))
    first = F.col("__c") == F.floor(F.greatest("e_start", "l_start") / bucket)  # a pair meets in several cells and counts in one
    over = F.least("e_end", "l_end") - F.greatest("e_start", "l_start")
    hit = own.join(cut, [*keys, "__c"]).where((F.col("l_start") < F.col("e_end")) & (F.col("l_end") > F.col("e_start")) & first).select(*keys, "epoch_idx", "e_start", "e_end", "label", "l_start", "l_end", over.alias("overlap"))
    w = W.partitionBy(*keys, "epoch_idx").orderBy(F.desc("overlap"), "l_start", "l_end")
    best = hit.where((F.col("overlap") > 0) & (F.col("overlap") >= min_share * (F.col("e_end") - F.col("e_start")))).withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "epoch_idx", "label", "overlap")
    return epochs.join(best, [*keys, "epoch_idx"], "left")


def atomic_segments(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cuts time at every boundary of two interval tables; keeps segments that both label, by their midpoint.

    One sweep over each recording's boundaries, in which every side's interval that began last is held. `keys` name a
    recording; intervals of one side don't overlap within one. Returns `keys, t, t2, duration, a_state, b_state` and the
    bounds of the interval of `b`, `b_start, b_end`.
    """
    keys = keys or []
    bounds = []
    for side, name in ((a, "a"), (b, "b")):
        own = F.struct(F.col("start_time").alias("s"), F.col("end_time").alias("e"), F.col("state").alias("state"))
        at = side.where("end_time > start_time").select(*keys, F.explode(F.array(F.struct(F.col("start_time").alias("t"), own.alias("x")), F.struct(F.col("end_time").alias("t"), F.lit(None).cast(side.select(own).schema[0].dataType).alias("x")))).alias("r"))
        bounds.append(at.select(*keys, "r.t", F.col("r.x").alias(name)))
    edges = bounds[0].unionByName(bounds[1], allowMissingColumns=True).groupBy(*keys, "t").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    w = W.partitionBy(*keys).orderBy("t")
    held = lambda c: F.last(c, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    seg = edges.select(*keys, "t", F.lead("t").over(w).alias("t2"), held("a").alias("a"), held("b").alias("b")).withColumn("mid", (F.col("t") + F.col("t2")) / 2)
    inside = (F.col("mid") < F.col("a.e")) & (F.col("mid") < F.col("b.e"))
    return seg.where(inside).select(*keys, "t", "t2", (F.col("t2") - F.col("t")).alias("duration"), F.col("a.state").alias("a_state"), F.col("b.state").alias("b_state"), F.col("b.s").alias("b_start"), F.col("b.e").alias("b_end"))


def bout_purity(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per bout of the second side of `atomic_segments`: the first side's label that fills most of it (the first by name
    of equal ones), the labelled time and that label's share."""
    bout = [*(keys or []), F.col("b_start").alias("p_start"), F.col("b_end").alias("p_end")]
    by = segments.groupBy(*bout, "a_state").agg(F.sum("duration").alias("d"))
    names = [*(keys or []), "p_start", "p_end"]
    most = by.groupBy(*names).agg(F.max("d").alias("most"), F.sum("d").alias("total"))
    top = by.join(most, names).where("d = most").groupBy(*names).agg(F.min("a_state").alias("dominant"), F.first("total").alias("total"), F.first("most").alias("most"))
    return top.select(*names, "dominant", "total", (F.col("most") / F.col("total")).alias("purity"))


def absorb_brief(intervals: DataFrame, keys: list[str], max_break: float) -> DataFrame:
    """Absorbs intervals shorter than `max_break` between two of one state, leftmost first, until none is left.

    The rule looks at what earlier merges made: one pass over a recording's intervals with a stack of those that stand, in
    time linear in them.
    """
    schema = T.StructType([*(intervals.schema[k] for k in keys), T.StructField("state", T.StringType()), T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType())])

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("start_time", "ascending"), ("end_time", "ascending"), ("state", "ascending")])
        stack: list[tuple[str, float, float]] = []
        for state, start, end in zip(*(rows.column(c).to_pylist() for c in ("state", "start_time", "end_time")), strict=True):
            if len(stack) > 1 and stack[-2][0] == state and stack[-1][2] - stack[-1][1] < max_break:
                stack.pop()
                state, start, _ = stack.pop()
            stack.append((state, start, end))
        states, starts, ends = zip(*stack, strict=True)
        own = {k: pa.array([v.as_py()] * len(stack), v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table(own | {"state": pa.array(states, pa.string()), "start_time": pa.array(starts, pa.float64()), "end_time": pa.array(ends, pa.float64())})

    return intervals.select(*keys, "state", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time")).groupBy(*keys).applyInArrow(fold, schema)
