"""Correlation over time: windows in bouts, heads and tails, onsets, rank and subspace stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.operators import pairs as pr


def sliding_windows(bouts: DataFrame, window: int, step: int) -> DataFrame:
    """Windows of a fixed length that lie in a bout, by index from its start; ends count as inside."""
    n = F.floor((F.col("end_time") - F.col("start_time") - window) / step)
    return bouts.where(F.col("end_time") - F.col("start_time") >= window).withColumn("w", F.explode(F.sequence(F.lit(0), n))).withColumns({"w_start": F.col("start_time") + F.col("w") * step, "w_end": F.col("start_time") + F.col("w") * step + window})


def window_correlation(trace: DataFrame, windows: DataFrame, keys: list[str], min_share: float, level: float = 0.2, recording: list[str] | None = None) -> DataFrame:
    """Summary of pair r in each window whose samples, of all units, are present to `min_share`.

    `keys` name a window; those among them that also name a recording of the trace go into `recording`.
    """
    at = windows.withColumn("sample_idx", F.explode(F.sequence(F.ceil("w_start"), F.floor("w_end")))).select(*keys, "sample_idx").join(trace, [*(recording or []), "sample_idx"])
    ok = at.groupBy(*keys).agg(F.avg(F.col("value").isNotNull().cast("int")).alias("valid_share")).where(F.col("valid_share") >= min_share)
    r = pr.pearson(at, keys).groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.avg(F.coalesce(F.col("r") > level, F.lit(False)).cast("int")).alias("share_above"), F.count("r").alias("n_pairs"))
    return ok.join(r, keys)


def head_tail(trace: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Pair r over the first and the last n valid samples of each long enough bout, and tail - head.

    trace: `keys, sample_idx, unit_pos, value`, the keys naming a bout (of a recording); a sample is valid if every
    unit has it.
    """
    keys = keys or ["bout_idx"]
    valid = trace.groupBy(*keys, "sample_idx").agg(F.bool_and(F.col("value").isNotNull()).alias("ok")).where("ok")
    w = W.partitionBy(*keys)
    rank = valid.withColumns({"up": F.row_number().over(w.orderBy("sample_idx")), "down": F.row_number().over(w.orderBy(F.desc("sample_idx"))), "size": F.count(F.lit(1)).over(w)}).where(F.col("size") >= 2 * n)
    sides = rank.withColumn("side", F.explode(F.array_compact(F.array(F.when(F.col("up") <= n, "head"), F.when(F.col("down") <= n, "tail"))))).select(*keys, "sample_idx", "side")
    r = pr.pearson(trace.join(sides, [*keys, "sample_idx"]), [*keys, "side"])
    out = r.groupBy(*keys, "i", "j").pivot("side", ["head", "tail"]).agg(F.first("r"))
    clip = 0.999999
    return out.withColumns({"delta_r": F.col("tail") - F.col("head"), "delta_z": pr.to_z(F.col("tail"), clip) - pr.to_z(F.col("head"), clip)})


def onsets(bouts: DataFrame, onset: str, before: str | None, slack: float = 0.5, after: float = 0.01, keys: list[str] | None = None, min_before: float = 0.0, min_onset: float = 0.0) -> DataFrame:
    """Transitions: bouts of `onset`, of at least `min_onset`, with the last bout of `before` that ends within
    [start - slack, start + after], if it is no shorter than `min_before`. `keys` name a recording.

    Without `before` any state may come first, and nothing is known of the bout before (null bounds).
    """
    keys = keys or []
    long = bouts.where((F.col("state") == onset) & (F.col("end_time") - F.col("start_time") >= min_onset))
    a = long.select(*keys, F.col("start_time").alias("t0"), F.col("end_time").alias("on_end"))
    if before is None:
        return a.withColumns({"pre_start": F.lit(None).cast("double"), "pre_end": F.lit(None).cast("double")})
    b = bouts.where(F.col("state") == before).select(*keys, F.col("start_time").alias("pre_start"), F.col("end_time").alias("pre_end"))
    near = b.withColumn("cell", F.explode(F.sequence(F.floor(F.col("pre_end") - after), F.floor(F.col("pre_end") + slack))))
    hit = a.withColumn("cell", F.floor("t0")).join(near, [*keys, "cell"]).where((F.col("pre_end") >= F.col("t0") - slack) & (F.col("pre_end") <= F.col("t0") + after))
    last = hit.groupBy(*keys, "t0", "on_end").agg(F.max_by("pre_start", "pre_end").alias("pre_start"), F.max("pre_end").alias("pre_end"))
    return last.where(F.col("pre_end") - F.col("pre_start") >= min_before)


def transition_windows(transitions: DataFrame, window: float, step: float, reach_before: float, reach_after: float) -> DataFrame:
    """Windows before and after each onset, within the two bouts: `phase` pre or post, `k` from 0, `w_start`, `w_end` and
    `t_rel`, the centre less the onset. Each side starts at its first moment within reach and goes on by `step`."""
    t0, near = F.col("t0"), 1e-9
    low = F.greatest(t0 - reach_before, F.coalesce("pre_start", t0 - reach_before))
    sides = []
    for phase, a, b in (("pre", low, t0), ("post", t0, F.least(t0 + reach_after, "on_end"))):
        n = F.floor((b - a - window + near) / step)
        w = transitions.withColumns({"phase": F.lit(phase), "__a": a.cast("double"), "__n": n}).where("__n >= 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
        sides.append(w.withColumns({"w_start": F.col("__a") + F.col("k") * step, "w_end": F.col("__a") + F.col("k") * step + window}).drop("__a", "__n"))
    return sides[0].unionByName(sides[1]).withColumn("t_rel", F.col("w_start") + window / 2 - t0)


def transition_synchrony(trace: DataFrame, bouts: DataFrame, onset: str, before: str | None, window: float, step: float, reach_before: float, reach_after: float, min_share: float = 0.8, level: float = 0.2, keys: list[str] | None = None, min_before: float = 0.0, min_onset: float = 0.0) -> DataFrame:
    """Synchrony of all pairs in windows around the transitions of every recording: `keys, t0, phase, k, t_rel` and the
    summary of each window that has enough samples (`window_correlation`)."""
    keys = keys or []
    w = transition_windows(onsets(bouts, onset, before, keys=keys, min_before=min_before, min_onset=min_onset), window, step, reach_before, reach_after)
    name = [*keys, "t0", "phase", "k"]
    return window_correlation(trace, w, name, min_share, level, recording=keys).join(w.select(*name, "t_rel"), name)


def onset_windows(transitions: DataFrame, window: int, step: int, reach: int) -> DataFrame:
    """Windows up to `reach` before and after each onset, inside the two bouts; `t_rel` is centre - onset."""
    k = F.explode(F.sequence(F.lit(-reach // step), F.lit(reach // step)))
    at = transitions.withColumn("k", k).withColumns({"w_start": F.col("t0") + F.col("k") * step, "w_end": F.col("t0") + F.col("k") * step + window})
    inside = ((F.col("k") < 0) & (F.col("w_end") <= F.col("t0")) & (F.col("w_start") >= F.col("pre_start"))) | ((F.col("k") >= 0) & (F.col("w_end") <= F.col("on_end")))
    return at.where(inside).withColumn("t_rel", F.col("w_start") + window / 2 - F.col("t0"))


def onset_synchrony(trace: DataFrame, bouts: DataFrame, onset: str, before: str, window: int, step: int, reach: int, min_share: float) -> DataFrame:
    """Window correlation around the onsets of a state after another: `t0, k, t_rel` and the summary of each window."""
    w = onset_windows(onsets(bouts, onset, before), window, step, reach)
    return window_correlation(trace, w, ["t0", "k"], min_share).join(w.select("t0", "k", "t_rel"), ["t0", "k"])


def mean_by_bin(table: DataFrame, types: list[str], keys: list[str], cell: str, value: str = "r") -> DataFrame:
    """Mean of each cell over the pairs of the given types, then mean, spread and count over cells, per key."""
    one = table.where(F.col("pair_type").isin(types)).groupBy(*keys, cell).agg(F.avg(value).alias("m")).where("m is not null")
    return one.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("m").alias("n_cells"))


def bout_midpoints(summary: DataFrame, bouts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A bout's value at its midpoint, by state: a timeline."""
    at = bouts.select(*keys, "state", ((F.col("start_time") + F.col("end_time")) / 2).alias("midpoint"))
    return summary.where(F.col(value).isNotNull()).join(at, keys).select(*keys, "state", "midpoint", value)


def binned(df: DataFrame, keys: list[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Mean and standard error (two values or more) of y over `bins` of x in [0, 1], the last bin closed."""
    b = F.least(F.floor(F.col(x) * bins), F.lit(bins - 1))
    out = df.where(F.col(x).isNotNull()).withColumn("bin", b).groupBy(*keys, "bin").agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.count(y).alias("n"))
    return out.withColumn("sem", F.when(F.col("n") >= 2, F.col("sd") / F.sqrt("n"))).drop("sd")


def rank_stability(by_bout: DataFrame, lags: list[int], least: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Spearman of the pair values of bouts k and k + lag over pairs both have; `by_bout`: keys, bout_idx, pair, z."""
    keys = keys or []
    have = by_bout.where("z is not null").select(*keys, "bout_idx", "pair", "z")
    later = have.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).select(*keys, (F.col("bout_idx") - F.col("lag")).alias("bout_idx"), "lag", "pair", F.col("z").alias("z2"))
    both = have.join(later, [*keys, "bout_idx", "pair"])
    w = W.partitionBy(*keys, "bout_idx", "lag")
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, "bout_idx", "lag", c)) - 1) / 2
    r = both.withColumns({"x": rank("z"), "y": rank("z2")}).groupBy(*keys, "bout_idx", "lag").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    return r.where(F.col("n") >= least).select(*keys, "bout_idx", "lag", "n", pr.r_from_sums().alias("rho"))


def subspace_similarity(loadings: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Mean squared cosine of the principal angles of two bouts' first k orthonormal loadings, i < j.

    loadings: `keys, bout, component, unit_pos, loading`; missing rows drop out.
    """
    keys = keys or []
    have = loadings.where((F.col("component") < k) & F.col("loading").isNotNull())
    a = have.select(*keys, F.col("bout").alias("bout_i"), F.col("component").alias("ca"), "unit_pos", F.col("loading").alias("x"))
    b = have.select(*keys, F.col("bout").alias("bout_j"), F.col("component").alias("cb"), "unit_pos", F.col("loading").alias("y"))
    dots = a.join(b, [*keys, "unit_pos"]).where("bout_i < bout_j").groupBy(*keys, "bout_i", "bout_j", "ca", "cb").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    return dots.groupBy(*keys, "bout_i", "bout_j").agg((F.sum(F.col("d") * F.col("d")) / k).alias("similarity"))


def principal_components(trace: DataFrame, keys: list[str], k: int = 5, least: int = 4) -> DataFrame:
    """First k loadings and explained shares of each key's correlation matrix over complete samples.

    The correlations are summed on Spark; only a unit x unit matrix meets the eigen-solver of a key.
    """
    import numpy as np
    import pandas as pd

    units = trace.groupBy(*keys).agg(F.countDistinct("unit_pos").alias("u"))
    whole = trace.where("value is not null").join(units, keys).withColumn("c", F.count(F.lit(1)).over(W.partitionBy(*keys, "sample_idx"))).where("c = u").drop("c", "u")
    r = pr.pearson(whole, keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trace.select(*keys).schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.append(pdf["i"], pdf["j"]))
        columns = [*keys, "component", "unit_pos", "loading", "explained"]
        if pdf["r"].isna().any() or pdf["n"].min() < least:
            return pd.DataFrame({c: [] for c in columns})
        m = np.eye(len(names))
        a, b = np.searchsorted(names, pdf["i"]), np.searchsorted(names, pdf["j"])
        m[a, b] = m[b, a] = pdf["r"]
        values, vectors = np.linalg.eigh(m)
        order = np.argsort(-values)[:k]
        vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
        out = pd.DataFrame({"component": np.repeat(np.arange(len(order)), len(names)), "unit_pos": np.tile(names, len(order)), "loading": vectors.T.ravel(), "explained": np.repeat(values[order] / values.sum(), len(names))})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[columns]

    return r.groupBy(*keys).applyInPandas(solve, f"{kinds}, component int, unit_pos long, loading double, explained double")
