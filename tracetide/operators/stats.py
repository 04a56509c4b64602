"""Tests and summaries over pair tables, and classification metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tracetide.operators.blocks import cut

#: Pairs of a cell that are drawn from one row.
PACKED = 4096


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """Adds `__place`, the row's place from 0 in the order of the whole table, without bringing the table together.

    Rows go to ranges and are numbered there; the sizes of earlier ranges, one row each, are added.
    """
    dealt = cut(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = dealt.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n")).select("__p", before.alias("__start"))  # a row a range
    return dealt.withColumn("__p", part).join(F.broadcast(start), "__p").withColumn("__place", F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__start")


def medians(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """`keys, cols`: the exact median of each column's values within a key, whatever their number: they are read at the middle places
    of one order of the table. Keys without any value have no row."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("__c"), F.col(c).cast("double").alias("__x")) for k, c in enumerate(cols)]))
    by = [*keys, "__c"]
    placed = in_order(df.select(*keys, each.alias("__e")).select(*keys, "__e.*").where("__x is not null"), *by, "__x")
    ends = placed.groupBy(*by).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    middle = F.explode(F.array_distinct(F.array(F.col("__first") + F.floor((F.col("__n") - 1) / 2), F.col("__first") + F.floor(F.col("__n") / 2))))
    found = ends.select(*by, middle.alias("__place")).join(placed.select("__place", "__x"), "__place")
    return found.groupBy(*keys).agg(*[F.avg(F.when(F.col("__c") == k, F.col("__x"))).alias(c) for k, c in enumerate(cols)])


@pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""

    def beta(x: float, a: float, b: float) -> float:
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(1 - x, b, a)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or tiny)
                c = 1 + num / c or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return front * h

    return pd.Series([None if pd.isna(x) or pd.isna(n) or n <= 0 else beta(n / (n + x * x), n / 2, 0.5) for x, n in zip(t, df, strict=True)], dtype="float64")


def paired_test(wide: DataFrame) -> DataFrame:
    """Per pair: difference of z, its se, Z and two-sided p. wide: from `state_difference`."""
    se = F.sqrt(F.col("se_a") * F.col("se_a") + F.col("se_b") * F.col("se_b"))
    out = wide.withColumns({"se": se}).withColumn("zscore", F.try_divide(F.col("delta"), F.col("se")))
    return out.withColumn("p", two_sided_p("zscore"))


def meta_analysis(wide: DataFrame, cluster: str) -> DataFrame:
    """Inverse-variance mean per cluster, then fixed and random effects (DerSimonian-Laird) over clusters: one row."""
    v = F.col("se_a") * F.col("se_a") + F.col("se_b") * F.col("se_b")
    one = wide.withColumn("w", 1 / v).groupBy(cluster).agg((F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))
    s = one.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swyy"))
    q = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    s = s.withColumns({"fixed": F.col("swy") / F.col("sw"), "q": q})
    s = s.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0))))
    r = one.join(F.broadcast(s.select("tau2", "fixed", "q", "k"))).withColumn("wr", 1 / (1 / F.col("w") + F.col("tau2")))
    out = r.groupBy("tau2", "fixed", "q", "k").agg((F.sum(F.col("wr") * F.col("y")) / F.sum("wr")).alias("random"), (1 / F.sqrt(F.sum("wr"))).alias("se"))
    return out.withColumns({"low": F.col("random") - 1.959963984540054 * F.col("se"), "high": F.col("random") + 1.959963984540054 * F.col("se")})


@pandas_udf(DoubleType())
def student_quantile(df: pd.Series) -> pd.Series:
    """The point that 97.5 % of Student's t lie below, by bisection of its two-sided p. One row a test."""

    def one(n: float) -> float | None:
        if pd.isna(n) or n <= 0:
            return None
        low, high = 0.0, 1e7
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if student_p.func(pd.Series([mid]), pd.Series([n]))[0] > 0.05 else (low, mid)
        return (low + high) / 2

    return pd.Series([one(n) for n in df], dtype="float64")


def cluster_test(wide: DataFrame, cluster: str, summary: str = "median") -> DataFrame:
    """One-sample t over the clusters' summaries of delta, its 95 % interval, and the signed-rank sums; null p and interval
    below two clusters. Ranks come from an order over ranges; ties share the mean of their places."""
    pick = F.percentile("delta", F.lit(0.5)) if summary == "median" else F.avg("delta")
    one = wide.groupBy(cluster).agg(pick.alias("y"))
    placed = in_order(one.where("y <> 0").select("y", F.abs("y").alias("size")), "size")
    ties = placed.groupBy("size").agg(F.count(F.lit(1)).alias("c"), (F.avg("__place") + 1).alias("r"), F.count_if(F.col("y") > 0).alias("up"))
    s = one.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))
    c = F.col("c")  # a tie of c adds c (c^2 - 1)
    plus = ties.agg(F.coalesce(F.sum(F.col("up") * F.col("r")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((c - F.col("up")) * F.col("r")), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(c), F.lit(0)).cast("double").alias("n_ranked"), F.coalesce(F.sum(c * (c * c - 1)), F.lit(0)).cast("double").alias("ties"))
    se, df = F.col("sd") / F.sqrt("n"), (F.col("n") - 1).cast("double")
    out = s.join(F.broadcast(plus)).withColumns({"t": F.try_divide(F.col("mean"), se), "__q": student_quantile(df) * se})
    return out.withColumns({"p": student_p("t", df), "w_p": signed_rank_p("n_ranked", "w_plus", "w_minus", "ties"), "low": F.col("mean") - F.col("__q"), "high": F.col("mean") + F.col("__q")}).drop("sd", "n_ranked", "ties", "__q")


@pandas_udf(DoubleType())
def signed_rank_p(n: pd.Series, plus: pd.Series, minus: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p of the signed-rank test: exact for up to 50 untied ranks, else normal with tied variance. One row a test."""

    def one(k: float, a: float, b: float, t: float) -> float | None:
        if pd.isna(k) or k < 1:
            return None
        k, low = int(k), min(a, b)
        if k <= 50 and t == 0:
            ways = np.ones(1)
            for rank in range(1, k + 1):  # subsets of the ranks by their sums
                ways = np.append(ways, np.zeros(rank)) + np.append(np.zeros(rank), ways)
            return min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**k)
        spread = math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - t / 48)
        return math.erfc(abs(low - k * (k + 1) / 4) / spread / math.sqrt(2)) if spread > 0 else None

    return pd.Series([one(*x) for x in zip(n, plus, minus, ties, strict=True)], dtype="float64")


def bootstrap(wide: DataFrame, levels: list[str], n: int, seed: int = 0) -> DataFrame:
    """Resamples subject, then cell, then pair, n times; one row a replicate: the mean of the cells' means.

    Draws come from hashes, so they don't depend on how rows are stored. Every level's items are numbered
    within their parent and drawn by equality of numbers. A cell of up to `PACKED` pairs is one row of its differences, from which
    each draw of the cell takes its pairs; pairs of larger cells are drawn as rows.
    """
    top, mid = levels
    pairs = cut(wide.select(top, mid, "i", "j", "delta"))
    subjects = in_order(pairs.select(top).distinct(), top).withColumnRenamed("__place", "k")
    cells = pairs.groupBy(top, mid).agg(F.count(F.lit(1)).alias("np")).withColumn("kc", F.row_number().over(W.partitionBy(top).orderBy(mid)) - 1)
    ns = subjects.agg(F.count(F.lit(1)).alias("ns"))
    nc = cells.groupBy(top).agg(F.count(F.lit(1)).alias("nc"))
    reps = wide.sparkSession.range(n).withColumnRenamed("id", "rep").join(F.broadcast(ns)).withColumn("d1", F.explode(F.sequence(F.lit(1), F.col("ns"))))
    s = reps.withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "rep", "d1"), "ns")).join(subjects, "k").join(nc, top)
    c = s.withColumn("d2", F.explode(F.sequence(F.lit(1), F.col("nc")))).withColumn("kc", F.pmod(F.xxhash64(F.lit(seed), "rep", "d1", "d2"), "nc")).select("rep", "d1", "d2", top, "kc").join(cells, [top, "kc"]).drop("kc")
    draw = lambda d3: F.pmod(F.xxhash64(F.lit(seed), "rep", "d1", "d2", d3), "np")
    sized = pairs.join(cells.drop("kc"), [top, mid])
    lists = sized.where(F.col("np") <= PACKED).groupBy(top, mid).agg(F.sort_array(F.collect_list(F.struct("i", "j", "delta"))).alias("x")).select(top, mid, F.col("x.delta").alias("x"))
    own = F.filter(F.transform(F.sequence(F.lit(1), F.col("np")), lambda d3: F.col("x")[draw(d3)]), lambda v: v.isNotNull())
    small = c.where(F.col("np") <= PACKED).join(lists, [top, mid]).select("rep", own.alias("x"))
    small = small.select("rep", F.try_divide(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), F.size("x")).alias("m"))
    rows = sized.where(F.col("np") > PACKED).withColumn("kp", F.row_number().over(W.partitionBy(top, mid).orderBy("i", "j")) - 1).drop("np")
    p = c.where(F.col("np") > PACKED).withColumn("d3", F.explode(F.sequence(F.lit(1), F.col("np")))).withColumn("kp", draw(F.col("d3"))).join(rows, [top, mid, "kp"])
    large = p.groupBy("rep", "d1", "d2").agg(F.avg("delta").alias("m")).select("rep", "m")
    return small.unionByName(large).groupBy("rep").agg(F.avg("m").alias("statistic"))


def confusion(df: DataFrame, truth: str, predicted: str, weight: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """`keys, truth, predicted, n`: counts or summed weights over rows with both labels."""
    by = [*(keys or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")]
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))


def label_metrics(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label (of each key), with the overall accuracy beside them."""
    by = keys or []
    rows = matrix.groupBy(*by, F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    cols = matrix.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    hits = matrix.where("truth = predicted").select(*by, F.col("truth").alias("label"), F.col("n").alias("hits"))
    total = matrix.groupBy(*by).agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    out = rows.join(cols, [*by, "label"], "full").join(hits, [*by, "label"], "left").na.fill(0, ["support", "predicted", "hits"])
    out = out.join(total, by) if by else out.join(F.broadcast(total))
    out = out.withColumns({"precision": F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0)), "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
