"""Correlation of all pairs of units, its aggregation over bouts, and what is derived from pair tables.

Samples go to blocks of time and units to tiles, a row a unit and block; pairs of a tile meet in one group as products of
matrices, and only sums leave it, so rows that move don't grow with the pairs of each sample. Missing samples drop out per pair.
The sums of a tile move as one row, so no task holds a table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetide.operators.blocks import cut
from tracetide.operators.stats import medians

CLIP = 1 - 1e-7
#: Samples of a block and units of a tile whose pairs are summed in one group.
LAG_BLOCK, LAG_TILE = 4096, 64


def packed(have: DataFrame, keys: list[str], block: int, around: int = 0) -> DataFrame:
    """`keys, unit_pos, __b, __at, __v`: a row a unit and block of `block` samples with those up to `around` beside it, so that rows
    that are moved and sorted are few. have: `keys, sample_idx, unit_pos, value` without nulls."""
    at = F.col("sample_idx")
    cell = F.explode(F.sequence(F.floor((at - around) / block), F.floor((at + around) / block))) if around else F.floor(at / block)
    rows = have.withColumn("__b", cell).groupBy(*keys, "unit_pos", "__b").agg(F.collect_list(F.struct("sample_idx", F.col("value").cast("double").alias("value"))).alias("__p"))
    return rows.select(*keys, "unit_pos", "__b", F.col("__p.sample_idx").alias("__at"), F.col("__p.value").alias("__v"))


def tiled(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Rows of `packed` as unit i of the tiles from their own on and as unit j of those up to it: adds `__ti`, `__tj`, `__role` (0 as
    i, 1 as j, 2 as both in the unit's own tile). Rows without a key meet nothing."""
    t = F.floor(F.col("unit_pos") / tile)
    ends = {"__t0": F.min(t), "__t1": F.max(t)}
    if keys:  # rows that lie by some of the keys already stay where they are
        w = W.partitionBy(*keys)
        at = rows.na.drop(subset=keys).withColumns({c: e.over(w) for c, e in ends.items()})
    else:
        at = rows.join(F.broadcast(rows.agg(*[e.alias(c) for c, e in ends.items()])))
    at = at.withColumn("__t", t)
    met = at.withColumn("__o", F.explode(F.sequence("__t0", "__t1"))).drop("__t0", "__t1")
    role = F.when(F.col("__t") == F.col("__o"), 2).when(F.col("__t") < F.col("__o"), 0).otherwise(1)
    return met.withColumns({"__ti": F.least("__t", "__o"), "__tj": F.greatest("__t", "__o"), "__role": role}).drop("__t", "__o")


def _grid(rows: pa.Table, low: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(units in order; sums, counts, sums of squares and counts of values that aren't finite: 4 x units x n) from sample `low` on."""
    units, row = np.unique(rows.column("unit_pos").to_numpy(), return_inverse=True)
    at, v = (rows.column(c).combine_chunks() for c in ("__at", "__v"))
    place, x = at.flatten().to_numpy() - low, v.flatten().to_numpy()
    inside = (place >= 0) & (place < n)
    cell = (np.repeat(row, at.value_lengths().to_numpy()) * n + place)[inside]
    x = x[inside]
    good = np.isfinite(x)
    x = np.where(good, x, 0.0)
    return units, np.stack([np.bincount(cell, w, len(units) * n).reshape(len(units), n) for w in (x, None, x * x, ~good)])


def _ends(at: np.ndarray) -> tuple[int, int]:
    """(first sample, samples from it to the last)."""
    return (int(at.min()), int(at.max()) - int(at.min()) + 1) if len(at) else (0, 0)


SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _tile_sums(keys: list[str]):
    """The sums of all pairs of one tile in one block, as products of matrices of units by samples: one row of lists."""

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        role = rows.column("__role").to_numpy()
        low, n = _ends(rows.column("__at").combine_chunks().flatten().to_numpy())
        (left, (x, p, xx, bad)), (right, (y, q, yy, worse)) = (_grid(rows.filter(pa.array(role != k)), low, n) for k in (1, 0))
        both = p @ q.T
        i, j = np.nonzero((left[:, None] < right) & (both > 0.5))
        sums = [(a @ b.T)[i, j] for a, b in ((x, q), (p, y), (xx, q), (p, yy), (x, y))]
        if bad.any() or worse.any():
            gone = (bad @ q.T + p @ worse.T)[i, j] > 0
            sums = [np.where(gone, np.nan, v) for v in sums]
        own = {c: pa.array([v.as_py()], v.type) for c, v in zip([*keys, "__b", "__ti", "__tj"], key, strict=True)}
        lists = {"i": left[i], "j": right[j], "n": np.rint(both[i, j]).astype(np.int64)} | dict(zip(SUMS[1:], sums, strict=True))
        return pa.table(own | {c: pa.array([v]) for c, v in lists.items()}).slice(0, min(len(i), 1))

    return solve


def _added(keys: list[str]):
    """The pairs of each tile, a row each, their sums added over the tile's blocks. Rows come in order of tiles; what is held is the
    tile that may go on."""
    tile = [*keys, "__ti", "__tj"]

    def out(rows: pa.Table, first: np.ndarray, own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        return pa.table([*(rows.column(k).take(pa.array(first)) for k in keys), *map(pa.array, own)], [*keys, "i", "j", *SUMS]).to_batches()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if not rows.num_rows:
                continue
            at = np.stack([rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in tile])
            new = np.append(True, (at[:, 1:] != at[:, :-1]).any(0))
            first = np.flatnonzero(new)
            which = np.repeat(np.cumsum(new) - 1, rows.column("i").combine_chunks().value_lengths().to_numpy())
            own = [rows.column(c).combine_chunks().flatten().to_numpy() for c in ("i", "j", *SUMS)]
            if len(first) < rows.num_rows:
                order = np.lexsort((own[1], own[0], which))
                which, own = which[order], [c[order] for c in own]
                start = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in (which, *own[:2])], 0)))
                which, own = which[start], [c[start] for c in own[:2]] + [np.add.reduceat(c, start) for c in own[2:]]
            done = int(np.searchsorted(which, len(first) - 1))
            yield from out(rows, first[which[:done]], [c[:done] for c in own])
            rest = {c: rows.column(c).take(pa.array(first[-1:])) for c in tile} | {c: [v[done:]] for c, v in zip(("i", "j", *SUMS), own, strict=True)}
            held = pa.table(rest, schema=rows.schema)
        if held is not None:
            n = len(held.column("i")[0].values)
            yield from out(held, np.zeros(n, np.int64), [held.column(c).combine_chunks().flatten().to_numpy() for c in ("i", "j", *SUMS)])

    return add


def pair_sums(trace: DataFrame, keys: list[str], block: int = LAG_BLOCK, tile: int = LAG_TILE, tasks: int | None = None) -> DataFrame:
    """`keys, i, j, n` and sums of x, y, x², y², xy over samples both units have; made by `tasks` tasks, or as many as Spark takes."""
    have = trace.where("value is not null and unit_pos is not null and sample_idx is not null").select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), "unit_pos", "value")
    own, unit = [T.StructField(k, trace.schema[k].dataType) for k in keys], trace.schema["unit_pos"].dataType
    kinds = {"i": unit, "j": unit, "n": T.LongType()} | {c: T.DoubleType() for c in SUMS[1:]}
    at = [T.StructField(c, T.LongType()) for c in ("__b", "__ti", "__tj")]
    sums = tiled(packed(have, keys, block), keys, tile).groupBy(*keys, "__b", "__ti", "__tj").applyInArrow(_tile_sums(keys), T.StructType([*own, *at, *[T.StructField(c, T.ArrayType(k)) for c, k in kinds.items()]]))
    at = [*keys, "__ti", "__tj"]
    tiles = (sums.drop("__b").repartition(tasks, *at) if tasks else sums.drop("__b").repartition(*at)).sortWithinPartitions(*keys, "__ti", "__tj")
    return tiles.mapInArrow(_added(keys), T.StructType([*own, *[T.StructField(c, k) for c, k in kinds.items()]]))


def r_from_sums() -> Column:
    """Population correlation from the sums; null below two samples or without variance."""
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return F.when((n >= 2) & (vx > 1e-9) & (vy > 1e-9), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))


def pearson(trace: DataFrame, keys: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    keys = keys or []
    return pair_sums(trace, keys, tasks=tasks).select(*keys, "i", "j", r_from_sums().alias("r"), "n")


def to_z(r: Column, clip: float = CLIP) -> Column:
    """atanh of r within the clip; null stays null (least and greatest alone would skip it)."""
    return F.when(r.isNotNull(), F.atanh(F.greatest(F.lit(-clip), F.least(F.lit(clip), r))))


def simple_mean(by_bout: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean r of the bouts that have one, total n, and z of the mean."""
    out = by_bout.groupBy(*(keys or []), "i", "j").agg(F.avg("r").alias("r"), F.sum("n").alias("n_samples"), F.count("r").alias("n_bouts"))
    return out.withColumn("z", to_z(F.col("r")))


def fisher_mean(by_bout: DataFrame, keys: list[str] | None = None, weighted: bool = True) -> DataFrame:
    """z of each bout weighted by n - 3 (bouts with more than 3 samples), r = tanh z, se = 1 / sqrt(sum of weights)."""
    w = (F.col("n") - 3).cast("double") if weighted else F.lit(1.0)
    ok = by_bout.where("r is not null" + (" and n > 3" if weighted else "")).withColumns({"w": w, "zb": to_z(F.col("r"))})
    out = ok.groupBy(*(keys or []), "i", "j").agg(F.sum(F.col("w") * F.col("zb")).alias("s"), F.sum("w").alias("w"), F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_bouts"))
    return out.select(*(keys or []), "i", "j", (F.col("s") / F.col("w")).alias("z"), F.tanh(F.col("s") / F.col("w")).alias("r"), (1 / F.sqrt("w")).alias("se"), "n_samples", "n_bouts")


def pooled(trace: DataFrame, keys: list[str], bout: str = "bout_idx", centre: bool = True) -> DataFrame:
    """Centres each unit in each bout on its own mean, pools the sums over bouts, one r a pair; se = 1 / sqrt(n - 3)."""
    own = trace.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy(*keys, bout, "unit_pos"))) if centre else trace
    sums = pair_sums(own.select(*keys, bout, "sample_idx", "unit_pos", "value"), [*keys, bout])
    total = sums.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return total.select(*keys, "i", "j", r_from_sums().alias("r"), F.when(F.col("n") > 3, 1 / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)))).alias("se"), "n")


AGGREGATORS = {"simple_mean": simple_mean, "fisher_z": lambda b, k=None: fisher_mean(b, k, False), "fisher_z_weighted": fisher_mean}


def classify(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Adds both sides' group and type, `pair_type` and `same_type`.

    pair_type: within_group, between_same_type or between_cross_type; same_type: the two types in order.
    """
    a = units.select(F.col("unit_id").alias("i"), F.col("group_id").alias("group_i"), F.col("group_type").alias("type_i"))
    b = units.select(F.col("unit_id").alias("j"), F.col("group_id").alias("group_j"), F.col("group_type").alias("type_j"))
    kind = F.when(F.col("group_i") == F.col("group_j"), "within_group").when(F.col("type_i") == F.col("type_j"), "between_same_type").otherwise("between_cross_type")
    both = F.concat_ws("_", F.least("type_i", "type_j").cast("string"), F.greatest("type_i", "type_j").cast("string"))
    return pairs.join(a, "i").join(b, "j").withColumns({"pair_type": kind, "same_type": both})


def stratified(table: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median r and z per stratum; strata overlap, so each pair is exploded over its own. Medians come from an order of the
    table, as a stratum can hold every pair."""
    strata = F.array_compact(F.array(F.col("pair_type"), F.when(F.col("pair_type") != "within_group", F.concat(F.lit("type_"), F.col("same_type"))), F.lit("all_pairs")))
    rows, by = cut(table.select(*keys, strata.alias("__s"), "r", "z")).select(*keys, F.explode("__s").alias("stratum"), "r", "z"), [*keys, "stratum"]
    means = rows.groupBy(*by).agg(F.avg("r").alias("mean_r"), F.avg("z").alias("mean_z"), F.count(F.lit(1)).alias("n_pairs"), F.count("r").alias("n_with_data"))
    mid = medians(rows, by, ["r", "z"]).select(*[F.col(k).alias(f"__{k}") for k in by], F.col("r").alias("median_r"), F.col("z").alias("median_z"))
    both = means.join(mid, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]), "left")
    return both.select(*by, "mean_r", "median_r", "mean_z", "median_z", "n_pairs", "n_with_data")


def bout_synchrony(by_bout: DataFrame, units: DataFrame, keys: list[str], level: float = 0.2) -> DataFrame:
    """Per bout: mean and median r, share above a level (a missing r isn't), means per pair type."""
    at = classify(by_bout, units)
    means = [F.avg(F.when(F.col("pair_type") == t, F.col("r"))).alias(f"mean_{t}") for t in ("within_group", "between_same_type", "between_cross_type")]
    return at.groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.percentile("r", F.lit(0.5)).alias("median_r"), F.avg(F.coalesce(F.col("r") > level, F.lit(False)).cast("int")).alias("share_above"), *means, F.count(F.lit(1)).alias("n_pairs"))


def state_difference(table: DataFrame, a: str, b: str, cols: tuple[str, ...] = ("z", "se", "n_samples")) -> DataFrame:
    """Wide: pairs found in both states with both sides' columns and `delta` = z of a - z of b."""
    left = table.where(F.col("state") == a).select("i", "j", *[F.col(c).alias(f"{c}_a") for c in cols])
    right = table.where(F.col("state") == b).select("i", "j", *[F.col(c).alias(f"{c}_b") for c in cols])
    return left.join(right, ["i", "j"]).withColumn("delta", F.col("z_a") - F.col("z_b"))


def outliers(wide: DataFrame, n: int = 20, max_se: float | None = None, signed: bool = True) -> DataFrame:
    """The n pairs with the largest difference, ranked; a report."""
    rows = wide if max_se is None else wide.where((F.col("se_a") <= max_se) & (F.col("se_b") <= max_se))
    by = [F.desc("delta") if signed else F.desc(F.abs("delta")), "i", "j"]
    return rows.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*by)))


def _lag_sums(most: int, block: int, names: list[str]):
    """Sums of x_i[t + lag] x_j[t] and their counts over lags -L..L, for the pairs of one tile in one block of t."""

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        role, start = rows.column("__role").to_numpy(), key[-3].as_py() * block
        early, later = (rows.filter(pa.array(role != k)) for k in (1, 0))
        at = later.column("__at").combine_chunks().flatten().to_numpy()
        low, n = _ends(at[(at >= start) & (at < start + block)])  # unit j has the block alone, unit i the samples around it too
        size = 1 << (n + 2 * most).bit_length()
        spectra = []
        for part, shift in ((early, most), (later, 0)):
            units, grid = _grid(part, low - shift, n + 2 * shift)
            spectra.append((units, np.fft.rfft(grid[:2], size)))
        (left, fx), (right, fy) = spectra
        i, j, sums, counts = [], [], [], []
        for k, u in enumerate(left.tolist()):
            later = np.flatnonzero(right > u)
            if not len(later):
                continue
            product = np.fft.irfft(fx[:, k, None] * fy[:, later].conj(), size)[:, :, : 2 * most + 1]
            count = np.rint(product[1]).astype(np.int64)
            met = count.any(1)
            i += [u] * int(met.sum())
            j += right[later[met]].tolist()
            sums += list(product[0][met])
            counts += list(count[met])
        own = {c: pa.array([x.as_py()] * len(i), x.type) for c, x in zip(names, key, strict=False)}
        return pa.table(own | {"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "s": pa.array(sums, pa.list_(pa.float64())), "n": pa.array(counts, pa.list_(pa.int64()))})

    return solve


def lagged(trace: DataFrame, keys: list[str], most: int, block: int = LAG_BLOCK, tile: int = LAG_TILE) -> DataFrame:
    """Cross-correlation over lags -L..L after centring each unit; peak by size, the first of equal ones.

    A positive lag means that unit j leads: the sum runs over x_i[t + lag] x_j[t], divided by the zero-lag
    count and both spreads. Samples go to blocks of time, as unit i with the L samples around the block, and units to
    tiles; the products over all lags are made there by Fourier transforms, so what is shuffled doesn't grow with
    the lags but for one row of sums a pair and block.
    """
    have = trace.where("value is not null and unit_pos is not null and sample_idx is not null").select(*keys, F.col("unit_pos").cast("long").alias("unit_pos"), F.col("sample_idx").cast("long").alias("sample_idx"), "value")
    spread = have.groupBy(*keys, "unit_pos").agg(F.stddev_pop("value").alias("sd"), F.avg("value").cast("double").alias("mean"))
    mid = F.col("mean")
    c = packed(have, keys, block, most).join(spread.drop("sd"), [*keys, "unit_pos"]).withColumn("__v", F.transform("__v", lambda x: x - mid)).drop("mean")
    names = [*keys, "__b", "__ti", "__tj"]
    schema = T.StructType([*(have.schema[k] for k in keys), T.StructField("__b", T.LongType()), T.StructField("__ti", T.LongType()), T.StructField("__tj", T.LongType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.ArrayType(T.LongType()))])
    sums = tiled(c, keys, tile).groupBy(*names).applyInArrow(_lag_sums(most, block, names), schema)
    add = lambda col, zero: F.aggregate(F.collect_list(col), F.array_repeat(zero, 2 * most + 1), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    total = sums.groupBy(*keys, "i", "j").agg(add("s", F.lit(0.0)).alias("s"), add("n", F.lit(0).cast("long")).alias("n"))
    side = lambda u: spread.select(*keys, F.col("unit_pos").alias(u), F.col("sd").alias(f"s{u}"))
    both = total.join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"])
    r = lambda k: F.try_divide(F.col("s")[k], F.col("n")[most] * F.col("si") * F.col("sj"))
    at = F.transform(F.sequence(F.lit(0), F.lit(2 * most)), lambda k: F.struct(F.round(F.abs(r(k)), 9).alias("a"), (most - k).alias("l"), r(k).alias("r"), F.col("n")[k].alias("n")))
    best = both.select(*keys, "i", "j", F.array_max(F.filter(at, lambda x: (x["n"] > 0) & x["r"].isNotNull())).alias("b"))
    return best.where("b is not null").select(*keys, "i", "j", (-F.col("b.l")).alias("lag"), F.col("b.r").alias("peak_r"))


def to_matrix(table: DataFrame, value: str, units: list[int], diagonal: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """A symmetric matrix of a bounded list of units for each key, one row a unit and one column `u<unit>` each."""
    keys = keys or []
    sides = table.select(*keys, "i", "j", value).unionByName(table.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), value))
    both = sides.where(F.col("i").isin(units) & F.col("j").isin(units))
    diag = both.select(*keys, "i").distinct().select(*keys, "i", F.col("i").alias("j"), F.lit(diagonal).alias(value))
    out = both.unionByName(diag).groupBy(*keys, "i").pivot("j", units).agg(F.first(value))
    return out.withColumnsRenamed({str(u): f"u{u}" for u in units})
