"""Eye, video and dendrite geometry by sums and windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracetide.operators.stats import in_order


def _det(a: list[list[Column]]) -> Column:
    return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])


def fit_circles(points: DataFrame, keys: list[str], least: int = 4, order: str | None = None) -> DataFrame:
    """Weighted algebraic circle through each key's points: centre, diameter, and motion between keys in order.

    points: `keys, x, y, w`. Nine sums a key and a 3 x 3 system in column expressions; null below `least`
    points or if they lie on a line. Coordinates are centred on the key's mean first.
    """
    mean = W.partitionBy(*keys)
    p = points.where("x is not null and y is not null and w > 0").withColumns({"mx": F.avg("x").over(mean), "my": F.avg("y").over(mean)}).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    z = F.col("u") * F.col("u") + F.col("v") * F.col("v")
    w, u, v = F.col("w"), F.col("u"), F.col("v")
    terms = {"sw": w, "su": w * u, "sv": w * v, "suu": w * u * u, "suv": w * u * v, "svv": w * v * v, "suz": w * u * z, "svz": w * v * z, "sz": w * z}
    s = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), *[F.sum(e).alias(k) for k, e in terms.items()])
    c = lambda k: F.col(k)
    m = [[c("suu"), c("suv"), c("su")], [c("suv"), c("svv"), c("sv")], [c("su"), c("sv"), c("sw")]]
    rhs = [c("suz"), c("svz"), c("sz")]
    det = _det(m)
    part = lambda k: F.try_divide(_det([[rhs[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), det)
    ok = (F.col("n") >= least) & (F.abs(det) > 1e-9)
    s = s.withColumns({"a": F.when(ok, part(0)), "b": F.when(ok, part(1)), "c": F.when(ok, part(2))})
    out = s.select(*keys, "n", (F.col("mx") + F.col("a") / 2).alias("cx"), (F.col("my") + F.col("b") / 2).alias("cy"), F.when(F.col("c").isNotNull(), 2 * F.sqrt(F.greatest(F.lit(0.0), F.col("c") + (F.col("a") * F.col("a") + F.col("b") * F.col("b")) / 4))).alias("diameter"))
    if order:
        w2 = W.partitionBy(*[k for k in keys if k != order]).orderBy(order)
        good = out.where("cx is not null")
        step = F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w2), 2) + F.pow(F.col("cy") - F.lag("cy").over(w2), 2))
        out = out.join(good.select(*keys, F.coalesce(step, F.lit(0.0)).alias("motion")), keys, "left")
    return out


def eyelid_openness(points: DataFrame, keys: list[str], medial: str, lateral: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Likelihood-weighted mean distance of lid pairs across the canthus axis, over the eye's width.

    points: `keys, part, x, y, likelihood`.
    """
    parts = sorted({medial, lateral, *[x for p in pairs for x in p]})
    wide = points.groupBy(*keys).pivot("part", parts).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("likelihood").alias("l"))
    c = lambda part, k: F.col(f"`{part}_{k}`")
    dx, dy = c(lateral, "x") - c(medial, "x"), c(lateral, "y") - c(medial, "y")
    width = F.sqrt(dx * dx + dy * dy)
    across = [F.abs((c(a, "x") - c(b, "x")) * -dy + (c(a, "y") - c(b, "y")) * dx) / width for a, b in pairs]
    weight = [(c(a, "l") + c(b, "l")) / 2 for a, b in pairs]
    total = sum((F.coalesce(d * w, F.lit(0.0)) for d, w in zip(across, weight, strict=True)), F.lit(0.0))
    have = sum((F.when(d.isNotNull(), w).otherwise(0.0) for d, w in zip(across, weight, strict=True)), F.lit(0.0))
    return wide.select(*keys, width.alias("width"), F.try_divide(total, have).alias("open")).withColumn("open_norm", F.try_divide(F.col("open"), F.col("width")))


def centroids(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))


def bounding_box(pixels: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    return pixels.where("value is not null").groupBy(*keys).agg((F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"), (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"))


#: Points of a tile; segments of a block, and of the several blocks that meet a tile in one group.
TILE, BLOCK, MEET = 1 << 15, 256, 1 << 16
#: Tasks for the groups, by number: few bytes may be much work, so sizes don't tell how many are needed.
TASKS = 256
#: Squares of distances count as equal up to 9 decimals, so distances up to the root of that; more than it, for safety.
SLACK = 1e-4


def _nearest(p: np.ndarray, a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place on it from 0 to 1, squared distance to 9 decimals) for every point, the first of equal segments.

    Points are halved again and again; a half keeps the segments no further from its centre than the nearest one and
    its own diameter, as no other can be nearest to any of its points.
    """
    n2 = (d * d).sum(1)

    def off(q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = q[:, 0, None] - a[s, 0], q[:, 1, None] - a[s, 1]
        t = np.clip(np.divide(x * d[s, 0] + y * d[s, 1], n2[s], out=np.zeros(x.shape), where=n2[s] > 0), 0.0, 1.0)
        return t, (x - t * d[s, 0]) ** 2 + (y - t * d[s, 1]) ** 2

    best, place, d2 = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p))
    todo = [(np.arange(len(p)), np.arange(len(a)))]
    while todo:
        own, s = todo.pop()
        low, high = p[own].min(0), p[own].max(0)
        far = np.sqrt(off(((low + high) / 2)[None], s)[1][0])
        reach = far.min() + np.hypot(*(high - low))
        s = s[far <= reach + SLACK + 1e-9 * reach]
        same = (low == high).all()
        if same or len(own) <= 16 or len(own) * len(s) <= 4096:
            t, e = off(p[own[:1]] if same else p[own], s)
            e = np.round(e, 9)
            k = e.argmin(1)
            row = np.arange(len(k))
            best[own], place[own], d2[own] = s[k], t[row, k], e[row, k]
            continue
        half = len(own) // 2
        order = np.argpartition(p[own, int((high - low).argmax())], half)
        todo += [(own[order[:half]], s), (own[order[half:]], s)]
    return best, place, d2


def arc_length(points: DataFrame, vertices: DataFrame, line: str, point: str) -> DataFrame:
    """Projects points to the nearest segment of their polyline: distance along it from the first vertex, and off it.

    points: `line, point, x, y`; vertices: `line, pos, x, y`. Points lie in tiles of neighbours and successive segments in
    blocks. A tile meets the blocks that, by centres and radii, may hold the nearest segment of one of its points; the
    points of a tile and the segments of some of these blocks are compared in one group. Points and segments that lack a
    coordinate take no part.
    """
    w = W.partitionBy(line).orderBy("pos")
    xy = lambda df, *own: df.select(*own, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = lambda *cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in cols])
    seg = xy(vertices, line, "pos").withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "__k": F.row_number().over(w) - 1}).where("x2 is not null")
    seg = seg.withColumn("len", F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)))
    seg = seg.withColumn("before", F.sum("len").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("len")).where(known("x", "y", "x2", "y2")).select(line, F.floor(F.col("__k") / BLOCK).alias("__b"), F.col("__k").cast("long").alias("__k"), "x", "y", "x2", "y2", "len", "before")

    def circle(df: DataFrame, by: list[str], xs: list[str], ys: list[str], name: str) -> DataFrame:
        """Centre and radius of what lies under each of `by`."""
        ends = df.groupBy(*by).agg(*[f(g(*[F.col(c) for c in cs]) if len(cs) > 1 else F.col(cs[0])).alias(f"__{k}{c}") for c, cs in (("x", xs), ("y", ys)) for k, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))])
        mid = {c: (F.col(f"__low{c}") + F.col(f"__high{c}")) / 2 for c in "xy"}
        return ends.select(*by, mid["x"].alias(f"__{name}x"), mid["y"].alias(f"__{name}y"), (F.hypot(F.col("__highx") - F.col("__lowx"), F.col("__highy") - F.col("__lowy")) / 2).alias(f"__{name}r"))

    blocks = circle(seg, [line, "__b"], ["x", "x2"], ["y", "y2"], "c")
    p = xy(points, line, point).where(known("x", "y"))
    size = p.groupBy(line).agg(F.min("x").alias("__a"), (F.max("x") - F.min("x")).alias("__w"), F.ceil(F.sqrt(F.count(F.lit(1)) / TILE)).alias("__strips"))
    strip = F.coalesce(F.floor(F.try_divide((F.col("x") - F.col("__a")) * F.col("__strips"), F.col("__w"))), F.lit(0).cast("long"))
    placed = in_order(p.join(size, line).select(line, point, "x", "y", strip.alias("__s")), line, "__s", "y", "x", point)
    placed = placed.select(line, point, "x", "y", F.floor(F.col("__place") / TILE).alias("__tile"))

    apart = F.hypot(F.col("__tx") - F.col("__cx"), F.col("__ty") - F.col("__cy"))
    near = circle(placed, [line, "__tile"], ["x"], ["y"], "t").join(blocks, line).select(line, "__tile", "__b", apart.alias("__d"), (F.col("__tr") + F.col("__cr")).alias("__r"))
    reach = F.min(F.col("__d") + F.col("__r")).over(W.partitionBy(line, "__tile"))
    near = near.withColumn("__reach", reach).where(F.col("__d") - F.col("__r") <= F.col("__reach") * (1 + 1e-9) + SLACK).select(line, "__tile", "__b", F.floor(F.col("__b") * BLOCK / MEET).alias("__m"))
    meet = [line, "__tile", "__m"]
    kind = points.schema[point].dataType
    nothing = lambda *cols: [F.lit(None).cast("double").alias(c) for c in cols]
    left = placed.join(near.select(*meet).distinct(), [line, "__tile"]).select(*meet, point, F.lit(None).cast("long").alias("__k"), "x", "y", *nothing("x2", "y2", "len", "before"))
    right = near.join(seg, [line, "__b"]).select(*meet, F.lit(None).cast(kind).alias(point), "__k", "x", "y", "x2", "y2", "len", "before")
    schema = T.StructType([points.schema[line], T.StructField(point, kind), T.StructField("d2", T.DoubleType()), T.StructField("pos", T.LongType()), T.StructField("s", T.DoubleType())])

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        is_segment = pc.is_valid(rows.column("__k"))
        own, s = rows.filter(pc.invert(is_segment)), rows.filter(is_segment).sort_by("__k")
        columns = lambda t, *names: np.column_stack([t.column(c).to_numpy() for c in names])
        a = columns(s, "x", "y")
        k, t, d2 = _nearest(columns(own, "x", "y"), a, columns(s, "x2", "y2") - a)
        arc = s.column("before").to_numpy()[k] + t * s.column("len").to_numpy()[k]
        return pa.table({line: pa.array([key[0].as_py()] * len(k), key[0].type), point: own.column(point), "d2": d2, "pos": s.column("__k").to_numpy()[k], "s": arc})

    found = left.unionByName(right).repartition(TASKS, *meet).groupBy(*meet).applyInArrow(solve, schema)
    return found.groupBy(line, point).agg(F.min(F.struct("d2", "pos", "s")).alias("b")).select(line, point, F.col("b.s").alias("arc"), F.sqrt("b.d2").alias("off"))


def order_along(points: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """`pos` from 0 along each key, missing last, ties in the given order."""
    return points.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last(), tie)) - 1)


def frame_differences(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean absolute change of the masked pixels from frame to frame, 0 for the first. pixels: `frame, y, x, grey`."""
    w = W.partitionBy("y", "x").orderBy("frame")
    at = pixels.join(mask.select("y", "x").distinct(), ["y", "x"], "left_semi").withColumn("d", F.abs(F.col("grey") - F.lag("grey").over(w)))
    return at.groupBy("frame").agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("change"))


def trial_table(trials: DataFrame, keys: list[str], fs: float, frame_rate: float = 80.0) -> DataFrame:
    """Sample ranges of trials: round(frames x fs / rate) samples each, one after the other."""
    w = W.partitionBy(*keys).orderBy("trial")
    n = trials.withColumn("n_samples", F.round(F.col("n_frames") * fs / frame_rate).cast("long"))
    return n.withColumn("last_sample", F.sum("n_samples").over(w)).withColumn("first_sample", F.col("last_sample") - F.col("n_samples"))


def select_trials(trials: DataFrame, t1: float, t2: float, fs: float) -> DataFrame:
    """Trials that overlap [t1, t2] and the slice of samples inside; empty slices go."""
    a, b = F.greatest(F.col("first_sample"), F.round(F.lit(t1 * fs)).cast("long")), F.least(F.col("last_sample"), F.round(F.lit(t2 * fs)).cast("long"))
    return trials.withColumns({"slice_start": a, "slice_end": b}).where("slice_end > slice_start")


def evenly_spaced(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at floor((k + 0.5) N / n) in order; a sample by design.

    Places come from one stored order (`stats.in_order`): ranges that are dealt twice may be cut at other values each time.
    """
    total = rows.agg(F.count(F.lit(1)).alias("N"))
    at = rows.sparkSession.range(n).join(F.broadcast(total)).select(F.floor((F.col("id") + 0.5) * F.col("N") / n).alias("__place")).distinct()
    return in_order(rows, order).join(F.broadcast(at), "__place", "left_semi").drop("__place")
