"""Compositions over bouts and pairs, selectors, and small table rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.operators import dynamics as dy
from tracetide.operators import intervals as iv
from tracetide.operators import pairs as pr


def in_bouts(trace: DataFrame, bouts: DataFrame, extra: list[str] | None = None, recording: list[str] | None = None) -> DataFrame:
    """Samples within each bout of their recording, both ends in: adds `bout_idx, state` and further columns of the bout."""
    recording = recording or []
    cols = [*recording, "bout_idx", "state", *(extra or [])]
    at = bouts.select(*cols, F.explode(F.sequence(F.ceil("start_time"), F.floor("end_time"))).alias("sample_idx"))
    return trace.join(at, [*recording, "sample_idx"])


def state_pair_table(trace: DataFrame, bouts: DataFrame, units: DataFrame, aggregator: str = "fisher_z_weighted", extra: list[str] | None = None, equal_bouts: bool = False, seed: int = 0, recording: list[str] | None = None) -> DataFrame:
    """One row a pair and state (and further key, such as a period): r, z, se, counts, groups and pair types.

    With `recording`, the columns that name one in the trace and the bouts, many recordings go through one plan:
    samples meet the bouts of their own recording only, and pairs stay inside it; unit ids name units of all.

    With `equal_bouts` every state keeps as many bouts, drawn by hash, as the state with the fewest.
    """
    recording = recording or []
    keys = [*recording, "state", *(extra or [])]
    if equal_bouts:
        rank = bouts.withColumn("__r", F.row_number().over(W.partitionBy(*recording, "state").orderBy(F.xxhash64(F.lit(seed), "start_time"), "start_time")))
        least = bouts.groupBy(*recording, "state").agg(F.count(F.lit(1)).alias("n")).groupBy(*recording).agg(F.min("n").alias("__n"))
        bouts = (rank.join(least, recording) if recording else rank.join(F.broadcast(least))).where(F.col("__r") <= F.col("__n")).drop("__r", "__n")
    by_bout = pr.pearson(in_bouts(trace, bouts, extra, recording), ["bout_idx", *keys])
    return pr.classify(pr.AGGREGATORS[aggregator](by_bout, keys), units)


def clock_pair_table(trace: DataFrame, bouts: DataFrame, window: float, recording: list[str] | None = None) -> DataFrame:
    """Pair correlation for each bin of cumulative time in state, per recording."""
    rec = recording or []
    slices = iv.state_clock_bins(bouts, window, rec).withColumn("bout_idx", F.row_number().over(W.partitionBy(*rec, "state").orderBy("slice_start"))).select(*rec, "bout_idx", "state", "bin", F.col("slice_start").alias("start_time"), F.col("slice_end").alias("end_time"))
    return pr.fisher_mean(pr.pearson(in_bouts(trace, slices, ["bin"], rec), [*rec, "bout_idx", "state", "bin"]), [*rec, "state", "bin"])


def bout_timeline(trace: DataFrame, bouts: DataFrame, window: int, step: int, min_share: float, least: float, recording: list[str] | None = None) -> DataFrame:
    """Window correlation in bouts of enough valid time, with their context and the window's place in the bout."""
    rec = recording or []
    long = iv.bout_context(bouts.where(F.col("valid_duration") >= least), rec)
    w = dy.sliding_windows(long, window, step)
    r = dy.window_correlation(trace, w, [*rec, "bout_idx", "w"], min_share, recording=rec)
    centre = (F.col("w_start") + F.col("w_end")) / 2
    return r.join(w, [*rec, "bout_idx", "w"]).withColumn("place", (centre - F.col("start_time")) / (F.col("end_time") - F.col("start_time"))).select(*rec, "bout_idx", "w", "state", "state_idx", "place", "mean_r", "n_pairs")


def less_baseline(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y less its mean where x < 0, per key."""
    return df.withColumn(y, F.col(y) - F.avg(F.when(F.col(x) < 0, F.col(y))).over(W.partitionBy(*keys)))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(q.alias("q"), F.count(value).alias("n"))
    return out.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "n")


def combine(tables: dict[int, DataFrame]) -> DataFrame:
    """One table of several with a `dmd` column and ids `dmd-unit`."""
    parts = [t.withColumns({"dmd": F.lit(k), "unit_id": F.concat_ws("-", F.lit(k), F.col("unit_id"))}) for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_positions(units: DataFrame, orders: DataFrame, order: str = "unit_order") -> DataFrame:
    """Adds `pos`, from 0, from a list of ids per row of `orders`; units in no list have none."""
    at = orders.select(*[c for c in orders.columns if c != order], F.posexplode(order).alias("pos", "unit_id"))
    return units.join(at, [c for c in at.columns if c != "pos"], "left")


def device_clock(epochs: DataFrame, keys: list[str], wall: str, device: str, block: str, offset: str) -> DataFrame:
    """Seconds of each epoch since the first, and its block time: the block's first offset plus the clock difference."""
    w, wb = W.partitionBy(*keys).orderBy(wall), W.partitionBy(*keys, block).orderBy(wall)
    return epochs.withColumns({"since_first": F.col(device) - F.first(device).over(w), "block_time": F.first(offset).over(wb) + F.col(device) - F.first(device).over(wb)})


def newest(models: DataFrame, name: str, time: str) -> DataFrame:
    """The newest row by time and then name, with a signature of both."""
    out = models.agg(F.max(F.struct(time, name)).alias("m")).select(F.col(f"m.{name}").alias(name), F.col(f"m.{time}").alias(time))
    return out.withColumn("signature", F.sha2(F.concat_ws("|", name, F.col(time).cast("string")), 256))


def mismatches(epochs: DataFrame, session: str, truth: str, predicted: str) -> DataFrame:
    """Runs of epochs where two labels differ, with both labels and length."""
    bad = epochs.where(~F.col(truth).eqNullSafe(F.col(predicted)))
    key = F.col("epoch_idx") - F.row_number().over(W.partitionBy(session, truth, predicted).orderBy("epoch_idx"))
    return bad.withColumn("run", key).groupBy(session, truth, predicted, "run").agg(F.min("epoch_idx").alias("first_epoch"), F.count(F.lit(1)).alias("n_epochs")).drop("run")


def time_slice(df: DataFrame, t1: float, t2: float, time: str = "sample_idx") -> DataFrame:
    """Both ends in."""
    return df.where(F.col(time).between(t1, t2))


def of_units(trace: DataFrame, units: DataFrame, where: Column) -> DataFrame:
    """Traces of the units whose metadata meets a condition; the filter runs on the unit table."""
    return trace.join(units.where(where).select("unit_id").distinct(), "unit_id", "left_semi")
