"""Clocks: offsets, blocks, nearest and as-of matches, pulses and audits of freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apply_offset(rows: DataFrame, offsets: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Adds each key's offset to the time columns; null where it is unknown."""
    out = rows.join(offsets.select(*keys, F.col("offset").alias("__o")), keys, "left")
    return out.withColumns({c: F.col(c) + F.col("__o") for c in cols}).drop("__o")


def assign_blocks(rows: DataFrame, blocks: DataFrame, time: str, bucket: float) -> DataFrame:
    """The first block, by start, whose [start, end] holds the time; rows in none have a null block and a status.

    Equal rows go through the join once and come out as often as they came in.
    """
    own = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("__copies")).withColumn("__c", F.floor(F.col(time) / bucket))
    cut = blocks.select("block_id", F.col("start_time").alias("__s"), F.col("end_time").alias("__e")).withColumn("__c", F.explode(F.sequence(F.floor(F.col("__s") / bucket), F.floor(F.col("__e") / bucket))))
    hit = own.join(cut, "__c", "left").withColumn("__in", (F.col(time) >= F.col("__s")) & (F.col(time) <= F.col("__e")))
    first = hit.groupBy(*rows.columns, "__copies").agg(F.min_by("block_id", F.when(F.col("__in"), F.struct("__s", "block_id"))).alias("block_id"))
    again = first.withColumn("__k", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).drop("__k", "__copies")
    return again.withColumn("status", F.when(F.col("block_id").isNull(), "no_block").otherwise("ok"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Gives each left row the last right value at or before it, by one sort of both together."""
    a = left.select(*keys, time, *[c for c in left.columns if c not in (*keys, time)], F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast("double").alias("__t"), F.lit(1).alias("__side"))
    b = right.select(*keys, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, time)], F.col(value).alias("__v"), F.col(time).cast("double").alias("__t"), F.lit(0).alias("__side"))
    w = W.partitionBy(*keys).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumns({"match": F.last("__v", True).over(w), "match_time": F.last("__t", True).over(w)}).where("__side = 1")
    if tolerance is not None:
        ok = F.col(time) - F.col("match_time") <= tolerance
        both = both.withColumns({"match": F.when(ok, F.col("match")), "match_time": F.when(ok, F.col("match_time"))})
    return both.drop("__v", "__t", "__side")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tolerance: float | None = None) -> DataFrame:
    """As `as_of` but the nearest on either side; the earlier of equally near ones."""
    others = [c for c in left.columns if c not in (*keys, time)]
    a = left.select(*keys, time, *others, F.lit(None).alias("__x").cast(right.select(F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v")).alias("x")).schema["x"].dataType).alias("__x"), F.lit(1).alias("__side"))
    b = right.select(*keys, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in others], F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v")).alias("__x"), F.lit(0).alias("__side"))
    forth, back = W.partitionBy(*keys).orderBy(time, "__side"), W.partitionBy(*keys).orderBy(F.desc(time), F.desc("__side"))  # frames that only grow: one that shrinks is read anew for each row
    both = a.unionByName(b).withColumns({c: F.last("__x", True).over(w.rowsBetween(W.unboundedPreceding, 0)) for c, w in (("p", forth), ("n", back))}).where("__side = 1")
    later = F.col("p").isNull() | (F.col("n.t") - F.col(time) < F.col(time) - F.col("p.t"))
    pick = F.when(F.col("n").isNotNull() & later, F.col("n")).otherwise(F.col("p"))
    if tolerance is not None:
        pick = F.when(F.abs(pick["t"] - F.col(time)) <= tolerance, pick)
    return both.withColumn("__m", pick).select(*keys, time, *others, F.col("__m.v").alias("match"), F.col("__m.t").alias("match_time"))


def closest_candidate(anchors: DataFrame, candidates: DataFrame, key: str, gap: Column) -> DataFrame:
    """Per anchor the candidate whose offset is closest to |gap| (the sign of the gap isn't known), the smaller of equal ones.

    Both sides are sorted together once, so no pairs arise. Anchors of a key without candidates drop out.
    """
    at = candidates.select(key, F.col("offset").cast("double").alias("__at"), "offset")
    own = anchors.withColumn("__at", F.abs(gap).cast("double"))
    return nearest(own, at, [key], "__at", "offset").where("match is not null").withColumnRenamed("match", "offset").drop("__at", "match_time")


def first_crossing(signal: DataFrame, keys: list[str], quiet: int, factor: float = 3.0) -> DataFrame:
    """First sample above `factor` times the largest of the first `quiet` samples."""
    level = signal.where(F.col("sample_idx") < quiet).groupBy(*keys).agg(F.max("value").alias("top"))
    return signal.join(level, keys).groupBy(*keys).agg(F.min(F.when(F.col("value") > F.col("top") * factor, F.col("sample_idx"))).alias("start_sample"))


def pulses(signal: DataFrame, keys: list[str], factor: float = 3.0, least: int = 20) -> DataFrame:
    """Rising edges: steps above a share of the largest step, not soon after another, one sample on, the first left out."""
    w = W.partitionBy(*keys).orderBy("sample_idx")
    step = signal.withColumn("d", F.col("value") - F.lag("value").over(w))
    edge = step.withColumn("top", F.max("d").over(W.partitionBy(*keys))).where(F.col("d") > F.col("top") / factor)
    kept = edge.withColumn("p", F.lag("sample_idx").over(w)).where(F.col("p").isNull() | (F.col("sample_idx") - F.col("p") >= least))
    return kept.withColumn("n", F.row_number().over(w)).where("n > 1").select(*keys, (F.col("sample_idx") + 1).alias("pulse"), (F.col("n") - 2).alias("frame"))


def reconcile_pulses(found: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Cuts surplus pulses, or goes on by the mean interval, to match each key's number of frames."""
    s = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"), F.min("pulse").alias("a"), F.max("pulse").alias("b")).join(frames, keys)
    mean = F.when(F.col("have") > 1, (F.col("b") - F.col("a")) / (F.col("have") - 1))
    more = s.where("n_frames > have").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_frames") - F.col("have")))).select(*keys, (F.col("b") + F.col("k") * mean).alias("pulse"), (F.col("have") + F.col("k") - 1).alias("frame"))
    kept = found.join(s.select(*keys, "n_frames"), keys).where(F.col("frame") < F.col("n_frames")).select(*keys, F.col("pulse").cast("double").alias("pulse"), F.col("frame").cast("long").alias("frame"))
    return kept.unionByName(more.withColumn("frame", F.col("frame").cast("long")))


def clock_of(events: DataFrame, keys: list[str], time: str, limit: Column, offset: Column) -> DataFrame:
    """Which clock each key's times are on: trial, block, ambiguous or empty, from their range."""
    r = events.groupBy(*keys).agg(F.min(time).alias("low"), F.max(time).alias("high"), F.first(limit, True).alias("top"), F.first(offset, True).alias("off"))
    trial = (F.col("low") >= 0) & (F.col("high") <= F.col("top"))
    block = (F.col("low") >= F.col("off")) & (F.col("high") <= F.col("top") + F.col("off"))
    return r.withColumn("clock", F.when(F.col("low").isNull(), "empty").when(trial & block, "ambiguous").when(trial, "trial").when(block, "block").otherwise("ambiguous"))


# --- audits ---------------------------------------------------------------------------------------


def freshness(expected: DataFrame, present: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Per key: fresh, stale (a version differs), missing (an output isn't there), or never run; stale before missing."""
    at = expected.join(present.withColumnRenamed(version, "__have"), [*keys, "output"], "left")
    s = at.groupBy(*keys).agg(F.count("__have").alias("n"), F.coalesce(F.bool_or(F.col("__have") != F.col(version)), F.lit(False)).alias("stale"), F.bool_or(F.col("__have").isNull()).alias("gap"))
    return s.select(*keys, F.when(F.col("n") == 0, "not_applicable").when(F.col("stale"), "stale").when(F.col("gap"), "missing").otherwise("fresh").alias("status"))


def worst_status(components: DataFrame, keys: list[str], severity: list[str]) -> DataFrame:
    """Per key the component whose status is worst, the first of equally bad ones. severity: from good to bad."""
    level = F.array_position(F.array(*[F.lit(x) for x in severity]), F.col("status"))
    top = F.max(F.struct(level.alias("l"), (-F.col("position")).alias("p"), "status", "component"))
    return components.groupBy(*keys).agg(top.alias("t")).select(*keys, F.col("t.status").alias("overall"), F.col("t.component").alias("component"))


def id_differences(expected: DataFrame, found: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Ids that are expected but not found, and found but not expected, per key; lists are sorted."""
    a = expected.select(*keys, F.col(item)).distinct().withColumn("a", F.lit(1))
    b = found.select(*keys, F.col(item)).distinct().withColumn("b", F.lit(1))
    both = a.join(b, [*keys, item], "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_unexpected"), F.min(F.when(F.col("b").isNull(), F.col(item))).alias("first_missing"), F.min(F.when(F.col("a").isNull(), F.col(item))).alias("first_unexpected")).withColumn("status", F.when((F.col("n_missing") == 0) & (F.col("n_unexpected") == 0), "ok").otherwise("mismatch"))


def ready(acquisitions: DataFrame, checks: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A boolean column for each check table that holds the key, and `ready` if all do."""
    out = reduce(lambda d, c: d.join(c[1].select(*keys).distinct().withColumn(c[0], F.lit(True)), keys, "left").na.fill(False, [c[0]]), checks.items(), acquisitions.select(*keys).distinct())
    return out.withColumn("ready", reduce(lambda a, b: a & b, [F.col(c) for c in checks]))


def to_rebuild(wanted: DataFrame, built: DataFrame, keys: list[str], version: str = "version", force: bool = False) -> DataFrame:
    """The wanted rows whose key and version haven't been built."""
    return wanted if force else wanted.join(built.select(*keys, version), [*keys, version], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    """All keys of both; old values stay, new keys get the default."""
    return old.select(*keys, value).join(new.select(*keys).distinct(), keys, "full").withColumn(value, F.coalesce(value, F.lit(default)))


def repeated_owners(rows: DataFrame, owner: str, scope: str) -> DataFrame:
    """Owners listed in more than one scope."""
    return rows.groupBy(owner).agg(F.countDistinct(scope).alias("n")).where("n > 1")


def event_tree(events: DataFrame, scope: str = "dmd", group: str = "group_id", owner: str = "owner_id", unit: str = "unit_id", depth: str = "owner_depth", metadata: DataFrame | None = None) -> DataFrame:
    """`owner, scope, group, n_units, depths`: distinct units of each group with events, and the depths its owner is listed
    with, in order; -1 is an unknown depth. Events without one of the four ids don't count.

    With `metadata(owner, scope, depth)` an owner's scope and depth are those listed there; an owner listed under two
    scopes is an error when the result is read.
    """
    known = F.when(F.col(depth) != -1, F.col(depth))
    own = events.dropna(subset=[owner, scope, group, unit])
    tree = own.groupBy(owner, scope, group).agg(F.countDistinct(unit).alias("n_units"), F.sort_array(F.collect_set(known)).alias("depths"))
    if metadata is None:
        return tree
    listed = metadata.groupBy(F.col(owner).alias("__o")).agg(F.countDistinct(scope).alias("__n"), F.min(scope).alias("__s"), F.sort_array(F.collect_set(known)).alias("__d"))
    both = tree.join(listed, tree[owner] == listed["__o"], "left")
    one = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.col("__o"), F.lit(" is listed under more than one "), F.lit(scope))).cast(events.schema[scope].dataType)).otherwise(F.coalesce("__s", scope))
    return both.select(owner, one.alias(scope), group, "n_units", F.when(F.col("__o").isNotNull(), F.col("__d")).otherwise(F.col("depths")).alias("depths"))
