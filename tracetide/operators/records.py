"""Rules about whole recordings: masks and channels, timing, blocks, listings, and tables put together from parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.operators import intervals as iv


# --- masks and channels ---------------------------------------------------------------------------


def with_validity(trace: DataFrame, keys: list[str], mask: DataFrame | None = None) -> DataFrame:
    """Adds `is_valid`: from `mask(keys, is_valid)` if given (false where it has no row), else the trace's own flag,
    else whether the value is there. A table of events without a flag is an error, as false isn't missing there."""
    if mask is not None:
        own = mask.select(*keys, F.col("is_valid").alias("__m"))
        return trace.drop("is_valid").join(own, keys, "left").withColumn("is_valid", F.coalesce("__m", F.lit(False))).drop("__m")
    if "is_valid" in trace.columns:
        return trace
    if dict(trace.dtypes)["value"] == "boolean":
        raise ValueError("events need a mask or a column is_valid")
    return trace.withColumn("is_valid", F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))


def single_channel(trace: DataFrame) -> DataFrame:
    """Drops `channel`; an error, raised by the job that reads it, if the table holds several."""
    if "channel" not in trace.columns:
        return trace
    seen = trace.agg(F.min("channel").alias("__a"), F.max("channel").alias("__b"))
    one = F.when(F.col("__a").eqNullSafe(F.col("__b")), True).otherwise(F.raise_error(F.concat(F.lit("several channels, among them "), F.col("__a").cast("string"), F.lit(" and "), F.col("__b").cast("string"))).cast("boolean"))
    return trace.join(F.broadcast(seen.select(one.alias("__one")).where("__one"))).drop("__one", "channel")


def unlikely_to_null(frames: DataFrame, metrics: list[str], likelihood: str, threshold: float = 0.2) -> DataFrame:
    """Metrics of frames below the likelihood become null; an unknown likelihood keeps them."""
    return frames.withColumns({m: F.when(F.col(likelihood) < threshold, F.lit(None)).otherwise(F.col(m)) for m in metrics})


def grid_classes(samples: DataFrame, keys: list[str], dt: float, gap_factor: float = 1.5) -> DataFrame:
    """`keys, cell, class`: every cell of a uniform grid from the first to the last sample as valid, missing or gap.

    samples: `keys, t, value`. A cell is a gap if no sample falls in it and its neighbours lie more than
    `gap_factor` steps apart, missing if it has no value or only such a neighbourhood as rounding explains.
    """
    w = W.partitionBy(*keys).orderBy("t")
    at = samples.withColumn("__0", F.min("t").over(W.partitionBy(*keys))).withColumns({"cell": F.round((F.col("t") - F.col("__0")) / dt).cast("long"), "__n": F.lead("t").over(w)})
    own = at.groupBy(*keys, "cell").agg(F.bool_or(F.col("value").isNotNull()).alias("__has"), F.max(F.coalesce(F.col("__n") - F.col("t"), F.lit(0.0))).alias("__to"))
    ends = own.withColumn("__next", F.lead("cell").over(W.partitionBy(*keys).orderBy("cell")))
    after = F.sequence(F.col("cell"), F.greatest(F.coalesce(F.col("__next") - 1, F.col("cell")), F.col("cell")))
    cells = ends.withColumn("__c", F.explode(after))
    kind = F.when(F.col("__c") == F.col("cell"), F.when(F.col("__has"), "valid").otherwise("missing")).when(F.col("__to") > gap_factor * dt, "gap").otherwise("missing")
    return cells.select(*keys, F.col("__c").alias("cell"), kind.alias("class"))


def state_seconds(mask: DataFrame, intervals: DataFrame, keys: list[str], states: list[str] | None = None, dt: float = 1.0) -> DataFrame:
    """Valid seconds per state; states that are asked for and don't occur have 0."""
    have = iv.samples_in_states(mask.where("is_valid"), intervals, keys).groupBy(*keys, "state").agg((F.count(F.lit(1)) * F.lit(dt)).alias("seconds"))
    base = intervals.select(*keys, "state").distinct() if states is None else intervals.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, states))).alias("state")) if keys else intervals.limit(1).select(F.explode(F.array(*map(F.lit, states))).alias("state"))
    return base.join(have, [*keys, "state"], "left").na.fill(0.0, ["seconds"])


def valid_epochs(mask: DataFrame, intervals: DataFrame, state: str, n: int, max_gap: int | None = None, min_bout: int | None = None, draw: int | None = None, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Epochs of n valid samples of a state with the index of their bout; a seeded subset in order of time if asked."""
    tiles = iv.tile_span(mask, intervals, state, n, max_gap, n if min_bout is None else min_bout, keys)
    at = with_bout(tiles, intervals, keys or [])
    return at if draw is None else iv.sample_rows(at, draw, seed).drop("draw").orderBy("start_time")


def with_bout(rows: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `bout_idx`, the number of the interval that holds the start; -1 where none does."""
    bouts = intervals.withColumn("bout_idx", F.row_number().over(W.partitionBy(*keys).orderBy("start_time")) - 1)
    spans = bouts.select(*keys, "bout_idx", F.col("start_time").alias("__s"), F.col("end_time").alias("__e")).withColumn("__c", F.explode(F.sequence(F.floor(F.col("__s") / 24), F.floor(F.col("__e") / 24))))
    on = [F.col(f"r.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("r.__c") == F.col("b.__c"), F.col("r.start_time") >= F.col("__s"), F.col("r.start_time") <= F.col("__e")]
    met = rows.withColumn("__c", F.floor(F.col("start_time") / 24)).alias("r").join(spans.alias("b"), on, "left")
    return met.groupBy(*[F.col(f"r.{c}") for c in rows.columns]).agg(F.coalesce(F.min("bout_idx"), F.lit(-1)).alias("bout_idx"))


def segments_in_state(mask: DataFrame, intervals: DataFrame, state: str, min_valid: float = 0.0, keys: list[str] | None = None, dt: float = 1.0) -> DataFrame:
    """Valid runs of a state as bouts: with the index of their interval, and at least `min_valid` seconds."""
    runs = iv.state_valid_runs(mask, intervals, [state], keys, dt).where(F.col("duration") >= min_valid)
    return with_bout(runs, intervals, keys or [])


# --- timing, blocks and listings ----------------------------------------------------------------


def timing(samples: DataFrame, keys: list[str], offsets: DataFrame) -> DataFrame:
    """Start, end and active seconds of each recording: `offset` + first time, `offset` + last time + a step, and samples
    times the median step. `several_blocks` tells where the recording spans more than one block. samples: `keys, block_id, t`."""
    w = W.partitionBy(*keys).orderBy("t")
    step = samples.withColumn("__d", F.col("t") - F.lag("t").over(w))
    s = step.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("t").alias("n"), F.percentile("__d", F.lit(0.5)).alias("dt"), (F.min("block_id") < F.max("block_id")).alias("several_blocks"))
    return s.join(offsets, keys, "left").select(*keys, (F.col("offset") + F.col("a")).alias("start"), (F.col("offset") + F.col("b") + F.col("dt")).alias("end"), (F.col("n") * F.col("dt")).alias("active"), "several_blocks")


def joined_blocks(blocks: list[DataFrame], dt: float) -> DataFrame:
    """Blocks of one store end to end: each one's `t` is shifted to a step after the end of those before; adds `block`."""
    every = reduce(lambda a, b: a.unionByName(b), [b.withColumn("block", F.lit(k)) for k, b in enumerate(blocks)])
    length = every.groupBy("block").agg((F.max("t") - F.min("t") + dt).alias("__l"), F.min("t").alias("__a"))
    shift = length.withColumn("__s", F.coalesce(F.sum("__l").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))  # a row a block
    return every.join(F.broadcast(shift), "block").withColumn("t", F.col("t") - F.col("__a") + F.col("__s")).drop("__l", "__a", "__s")


def carried_offset(broken: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    """For blocks without an offset: that of the good recording nearest in wall-clock start, moved by the difference of
    starts; null where the key has no good one. Both: `keys, started` (a timestamp); good: `offset` too."""
    at = lambda c: F.unix_micros(c) / 1e6
    met = broken.withColumn("__t", at(F.col("started"))).join(good.select(*keys, at(F.col("started")).alias("__g"), "offset"), keys, "left")
    best = met.groupBy(*broken.columns).agg(F.min_by(F.struct("__g", "offset"), F.struct(F.abs(F.col("__t") - F.col("__g")).alias("d"), F.col("__g").alias("g"))).alias("b"), F.first("__t").alias("__t"))
    return best.select(*broken.columns, (F.col("b.offset") + F.col("__t") - F.col("b.__g")).alias("offset"))


def block_list(acquisitions: DataFrame, blocks: DataFrame, inputs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(a row a block with its acquisitions in master order, and those without a block as `unresolved`; blocks without input)."""
    at = acquisitions.join(blocks, [*keys, "acq"], "left")
    rows = at.groupBy(*keys, "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "acq"))), lambda x: x["acq"]), ",").alias("acqs"))
    listed = rows.withColumn("status", F.when(F.col("block_id").isNull(), "unresolved").otherwise("ok"))
    return listed, listed.where("status = 'ok'").join(inputs, [*keys, "block_id"], "left_anti")


def frames_match(metrics: DataFrame, clock: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics with the clock's time, joined on `frame`; an error, raised by the job that reads them, where the numbers
    of frames differ."""
    n = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")).join(clock.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")), keys, "full")
    text = F.concat(F.lit("metrics have "), F.coalesce("__m", F.lit(0)).cast("string"), F.lit(" frames, the clock "), F.coalesce("__c", F.lit(0)).cast("string"))
    checked = n.select(*keys, F.when(F.col("__m").eqNullSafe(F.col("__c")), True).otherwise(F.raise_error(text).cast("boolean")).alias("__ok")).where("__ok")
    return metrics.join(clock, [*keys, "frame"]).join(checked.drop("__ok"), keys)


def done_versions(acquisitions: DataFrame, files: DataFrame, keys: list[str], name: str = "file", suffix: str = ".mat") -> DataFrame:
    """The newest version of each acquisition's summary file, 'NO' where there is none."""
    own = files.where(F.endswith(F.col(name), F.lit(suffix))).groupBy(*keys).agg(F.max(F.substring(name, F.lit(1), F.length(name) - len(suffix))).alias("done"))
    return acquisitions.join(own, keys, "left").na.fill("NO", ["done"])


def listing_report(found: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """Files that nothing wants, by the first `depth` parts of their path: how many and how large. found: `path, size`."""
    top = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    return found.join(wanted.select("path").distinct(), "path", "left_anti").groupBy(top.alias("prefix")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def audit_components(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A row a component: ids expected, missing and surplus, whether versions and shapes agree, and a status.

    Both: `keys, component, version, shape, ids` (an array)."""
    e = expected.select(*keys, "component", *[F.col(c).alias(f"e_{c}") for c in ("version", "shape", "ids")])
    f = found.select(*keys, "component", *[F.col(c).alias(f"f_{c}") for c in ("version", "shape", "ids")])
    both = e.join(f, [*keys, "component"], "full").withColumns({"missing": F.size(F.array_except("e_ids", F.coalesce("f_ids", F.expr("slice(e_ids, 1, 0)")))), "surplus": F.size(F.array_except("f_ids", F.coalesce("e_ids", F.expr("slice(f_ids, 1, 0)"))))})
    status = F.when(F.col("f_version").isNull(), "absent").when(F.col("e_version").isNull(), "unexpected").when(~F.col("e_version").eqNullSafe(F.col("f_version")), "outdated").when((F.col("missing") > 0) | (F.col("surplus") > 0), "other ids").when(~F.col("e_shape").eqNullSafe(F.col("f_shape")), "other shape").otherwise("ok")
    return both.select(*keys, "component", "missing", "surplus", status.alias("status"))


def lookup(metadata: DataFrame, key: Column, value: str) -> DataFrame:
    """Distinct values of a metadata column for the rows a condition picks, in order."""
    return metadata.where(key).select(value).distinct().orderBy(value)


def exploded_metadata(documents: DataFrame, schema: str, levels: list[str], doc: str = "document") -> DataFrame:
    """Nested JSON maps, one level a name, as rows: `levels..., entry`. Documents that don't parse give no rows."""
    kind = schema
    for _ in levels:
        kind = f"map<string,{kind}>"
    out = documents.select(F.from_json(doc, kind).alias("__0"))
    for k, name in enumerate(levels):
        keep = levels[:k]
        out = out.select(*keep, F.explode(f"__{k}").alias(name, f"__{k + 1}"))
    return out.withColumnRenamed(f"__{len(levels)}", "entry")


def named_points(raw: DataFrame) -> DataFrame:
    """`name, x, y` from `name, entry` where the entry is JSON of either form, `{"x": 1, "y": 2}` or `[1, 2]`."""
    pair, named = F.from_json("entry", "array<double>"), F.from_json("entry", "struct<x:double,y:double>")
    return raw.select("name", F.coalesce(F.get(pair, F.lit(0)), named["x"]).alias("x"), F.coalesce(F.get(pair, F.lit(1)), named["y"]).alias("y"))


# --- data of views --------------------------------------------------------------------------------


def eye_table(fits: DataFrame, lids: DataFrame, points: DataFrame, groups: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Pupil fits and eyelid measures side by side by frame, with the mean likelihood of each group of points, ungated."""
    means = points.groupBy(*keys).agg(*[F.avg(F.when(F.col("part").isin(parts), F.col("likelihood"))).alias(f"{name}_likelihood") for name, parts in groups.items()])
    return fits.join(lids, keys, "full").join(means, keys, "left")


def contrast(pixels: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99, frames: int = 200) -> DataFrame:
    """Two quantiles of grey over a sample of at most about `frames` frames, spread evenly; a sample by design."""
    n = pixels.groupBy(*keys).agg(F.min("frame").alias("__a"), F.max("frame").alias("__b"))
    every = F.greatest(F.lit(1), F.ceil((F.col("__b") - F.col("__a") + 1) / frames))
    own = pixels.join(n, keys) if keys else pixels.join(F.broadcast(n))
    q = own.where((F.col("frame") - F.col("__a")) % every == 0).groupBy(*keys).agg(F.percentile("grey", F.array(F.lit(low), F.lit(high))).alias("q"))
    return q.select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def block_extents(units: DataFrame, order: list[Column], levels: list[str], keys: list[str]) -> DataFrame:
    """Rows of a heat map: units in their canonical order per key, and the first and last row of each block of a level."""
    at = units.withColumn("row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return reduce(lambda a, b: a.unionByName(b), [at.groupBy(*keys, F.col(c).cast("string").alias("block")).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")).withColumn("level", F.lit(c)) for c in levels])


def movie_snr(trace: DataFrame, noise: DataFrame, keys: list[str], factor: float = 5.0, every: int = 10) -> DataFrame:
    """Value over `factor` times the noise at every tenth sample, 0 where missing, with the unit's limits (least, 95 %)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("sample_idx")) - 1
    at = trace.join(noise, keys).withColumn("__r", rank).where(F.col("__r") % every == 0)
    s = at.select(*keys, "sample_idx", F.coalesce(F.try_divide(F.col("value"), F.col("noise") * factor), F.lit(0.0)).alias("snr"))
    whole = W.partitionBy(*keys)
    return s.withColumns({"low": F.min("snr").over(whole), "high": F.percentile("snr", F.lit(0.95)).over(whole)})


def unit_pixels(pixels: DataFrame, units: DataFrame) -> DataFrame:
    """Pixels of the given units with each one's place along its group from 0 to 1; source ids are unit ids plus one."""
    w = W.partitionBy("group_id")
    place = F.coalesce(F.try_divide(F.col("pos") - F.min("pos").over(w), F.max("pos").over(w) - F.min("pos").over(w)), F.lit(0.0))
    own = units.withColumn("place", place).select((F.col("unit_id") + 1).alias("source_id"), "place")
    return pixels.join(own, "source_id")
