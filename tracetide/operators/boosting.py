"""Boosted state classifiers with calibration on rows that the ensembles haven't seen.

One ensemble a state and fold, fitted side by side by Spark's own trees; a calibrator maps each ensemble's margin to a
probability, and the probabilities of the folds are averaged. Rows are dealt to folds by a hash of their id.

Trees only see the bins of the features, so rows with equal bins, state and fold are one row with their summed weight: every
row counts, and passes of the fits don't grow with rows that repeat. Scoring bins features by the same cuts.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.operators.blocks import cut
from tracetide.operators.scoring import _calibrated, varying

#: Calibrators are fitted on so many bins of the margin, whose number doesn't grow with the rows.
BINS = 400
#: Bins of a feature; the trees see no more than these. They are cut at quantiles, read from so many points of each state.
FEATURE_BINS, POINTS = 32, 512
#: Above `FEATURE_BINS`, as Spark finds splits on a sample of the square of it in rows, which then holds every bin.
MAX_BINS = 1024


@dataclass
class BoostedModel:
    """For each fold an ensemble and a calibrator a state."""

    cols: list[str]
    states: list[str]
    folds: list[dict[str, GBTClassificationModel]]
    curves: list[dict[str, tuple]]
    cuts: list[list[float]] | None = None  # of each column's bins; None where trees take the values themselves


def feature_cuts(df: DataFrame, cols: list[str], label: str) -> list[list[float]]:
    """For each column the values that end its bins: quantiles of all rows, where states weigh the same, or all values if these
    are few. The last bin is open. Some points of each state come to the driver."""
    share = F.array(*[F.lit(k / POINTS) for k in range(POINTS + 1)])
    rows = df.groupBy(label).agg(*[F.percentile_approx(F.col(c).cast("double"), share, 10_000).alias(f"c{k}") for k, c in enumerate(cols)]).collect()
    out = []
    for k in range(len(cols)):
        points = sorted(v for r in rows for v in r[f"c{k}"])
        found = sorted({*points}) if len({*points}) <= FEATURE_BINS else [points[len(points) * q // FEATURE_BINS] for q in range(1, FEATURE_BINS)]
        out.append(sorted({v for v in found if v < points[-1]}))
    return out


def binned(df: DataFrame, cols: list[str], cuts: list[list[float]], prefix: str) -> DataFrame:
    """Adds `<prefix><k>`, the bin of column k: how many of its cuts lie below the value. Null or NaN is an error."""
    splits = [[-math.inf, *(math.nextafter(v, math.inf) for v in own), math.inf] for own in cuts]
    known = [k for k, own in enumerate(cuts) if own]  # a bucketizer needs a cut
    one = Bucketizer(splitsArray=[splits[k] for k in known], inputCols=[cols[k] for k in known], outputCols=[f"{prefix}{k}" for k in known])
    out = one.transform(df) if known else df
    # bins are marked as categories, but trees must take them in order
    return out.withColumns({f"{prefix}{k}": F.col(f"{prefix}{k}").alias("bin", metadata={}) if own else F.lit(0.0) for k, own in enumerate(cuts)})


def stratified(df: DataFrame, label: str, share: float, seed: int = 0, row_id: str = "row_id") -> Column:
    """Whether a row is held out: in each class about `share` of the rows, those with the smallest hashes of their ids.

    A class gives at least its smallest row; thresholds of the few classes come to the driver.
    """
    h = F.xxhash64(F.lit(seed), F.col(row_id))
    cuts = df.groupBy(label).agg(F.greatest(F.percentile_approx(h, share, 10_000), F.min(h)).alias("cut")).collect()
    return reduce(lambda a, b: a | b, [(F.col(label) == r[label]) & (h <= r["cut"]) for r in cuts], F.lit(False))


def _curve(held: DataFrame, isotonic: bool) -> tuple:
    """A rising curve from margins to shares of hits, logistic (slope, intercept) or by corners. held: `x, t, w`."""
    ends = held.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        mean = held.agg(F.sum(F.col("t") * F.col("w")) / F.sum("w")).first()[0]
        mean = min(1 - 1e-6, max(1e-6, 0.5 if mean is None else mean))
        return 0.0, math.log(mean / (1 - mean))
    place = F.floor((F.col("x") - ends["a"]) / ((ends["b"] - ends["a"]) / BINS))
    binned = held.groupBy(F.least(place, F.lit(BINS - 1)).alias("bin"), "t").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"), F.sum("w").alias("w"))
    rows = VectorAssembler(inputCols=["x"], outputCol="v").transform(binned)
    if isotonic:
        fit = IsotonicRegression(labelCol="t", featuresCol="x", weightCol="w").fit(rows)
        return [float(v) for v in fit.boundaries.toArray()], [float(v) for v in fit.predictions.toArray()]
    fit = LogisticRegression(labelCol="t", featuresCol="v", weightCol="w", regParam=1e-6).fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)


def train_boosted(
    df: DataFrame, cols: list[str], states: list[str], label: str = "label", seed: int = 0, folds: int = 3, rounds: int = 20, depth: int = 4, step: float = 0.2, isotonic: bool = False, holdout: float | None = None, threads: int = 4
) -> BoostedModel:
    """Fits `folds` times one boosted ensemble a state, each on the rows of the other folds and calibrated on its own.

    With `holdout` there is one fold: that share of each class calibrates and the rest is fitted. Classes are
    weighted by inverse counts. Features are cut into `FEATURE_BINS` bins. All states must occur, also outside each fold. df: complete feature columns,
    `label` and a long `row_id`.
    """
    found = {r[0] for r in df.select(label).distinct().limit(len(states) + 1).collect()}
    if found != set(states):
        raise ValueError(f"labels are {sorted(map(str, found))}, not {states}")
    cols = varying(df, cols)
    cuts = feature_cuts(df, cols, label)
    deal = stratified(df, label, holdout, seed).cast("int") if holdout else F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(folds)) + 1
    bins = [f"__b{k}" for k in range(len(cols))]
    alike = cut(binned(df.select(F.col(label).alias("state"), deal.alias("fold"), *cols), cols, cuts, "__b").groupBy("state", "fold", *bins).agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["state"]: r["n"] for r in alike.groupBy("state").agg(F.sum("n").alias("n")).collect()}
    share = reduce(lambda a, x: F.when(F.col("state") == x, sum(sizes.values()) / (sizes[x] * len(sizes))).otherwise(a), sizes, F.lit(None).cast("double"))
    rows = VectorAssembler(inputCols=bins, outputCol="features").transform(alike).select("state", (F.col("n") * share).alias("weight"), "fold", "features").persist()
    try:
        seen = {(r["state"], r["fold"]) for r in rows.select("state", "fold").distinct().collect()}
        parts = [1] if holdout else list(range(1, folds + 1))
        if any(all(f == k for s, f in seen if s == state) for k in parts for state in states):
            raise ValueError("a state has rows in one fold only")

        def fit(job: tuple[int, str]) -> tuple[GBTClassificationModel, tuple]:
            k, state = job
            own = rows.withColumn("t", (F.col("state") == state).cast("double"))
            trees = GBTClassifier(labelCol="t", weightCol="weight", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=step, maxBins=MAX_BINS, seed=seed).fit(own.where(F.col("fold") != k))
            held = trees.transform(own.where(F.col("fold") == k)).select(vector_to_array("rawPrediction")[1].alias("x"), "t", F.col("weight").alias("w"))
            return trees, _curve(held, isotonic)

        jobs = [(k, state) for k in parts for state in states]
        with ThreadPool(min(threads, len(jobs))) as pool:
            done = dict(zip(jobs, pool.map(inheritable_thread_target(df.sparkSession)(fit), jobs), strict=True))
    finally:
        rows.unpersist()
    return BoostedModel(cols, states, [{s: done[k, s][0] for s in states} for k in parts], [{s: done[k, s][1] for s in states} for k in parts], cuts)


def boosted_probabilities(df: DataFrame, model: BoostedModel) -> DataFrame:
    """`P_<state>`: the mean over folds of calibrated probabilities that add up to 1, none below 1e-12."""
    own, used = (model.cols, []) if model.cuts is None else (bins := [f"__b{k}" for k in range(len(model.cols))], bins)
    whole = df if model.cuts is None else binned(df, model.cols, model.cuts, "__b")
    out = VectorAssembler(inputCols=own, outputCol="__features").transform(whole)
    total = {s: F.lit(0.0) for s in model.states}
    for k, (trees, curves) in enumerate(zip(model.folds, model.curves, strict=True)):
        for s in model.states:
            one = trees[s].setFeaturesCol("__features").setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("")
            out = one.transform(out).withColumn(f"__{k}_{s}", F.greatest(F.lit(1e-12), _calibrated(vector_to_array("__raw")[1], *curves[s]))).drop("__raw")
        whole = reduce(lambda a, b: a + b, [F.col(f"__{k}_{s}") for s in model.states])
        total = {s: total[s] + F.col(f"__{k}_{s}") / whole for s in model.states}
    n = len(model.folds)
    helpers = ["__features", *used, *[f"__{k}_{s}" for k in range(n) for s in model.states]]
    return out.withColumns({f"P_{s}": F.greatest(F.lit(1e-12), p / n) for s, p in total.items()}).drop(*helpers)


def boosted_importance(spark: SparkSession, model: BoostedModel, n: int = 20) -> DataFrame:
    """`feature, importance` of the n features that matter most, averaged over folds and states; a report."""
    every = [m.featureImportances.toArray() for fold in model.folds for m in fold.values()]
    rows = [(c, float(sum(e[i] for e in every) / len(every))) for i, c in enumerate(model.cols)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def log_loss(df: DataFrame, states: list[str], label: str = "label") -> DataFrame:
    """`(n, log_loss)`: the mean of -ln P of the rows' own states."""
    p = reduce(lambda a, s: F.when(F.col(label) == s, F.col(f"P_{s}")).otherwise(a), states, F.lit(None).cast("double"))
    return df.agg(F.count(p).alias("n"), F.avg(-F.ln(p)).alias("log_loss"))


def save_boosted(spark: SparkSession, model: BoostedModel, path: str) -> None:
    """Writes every ensemble and the calibrators under `path`, replacing what is there."""
    for k, fold in enumerate(model.folds):
        for j, s in enumerate(model.states):
            fold[s].write().overwrite().save(f"{path}/fold{k}_state{j}")
    rest = json.dumps({"cols": model.cols, "states": model.states, "curves": model.curves, "cuts": model.cuts})
    spark.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_boosted(spark: SparkSession, path: str) -> BoostedModel:
    rest = json.loads(spark.read.text(f"{path}/model").first()[0])
    curves = [{s: tuple(c) for s, c in fold.items()} for fold in rest["curves"]]
    folds = [{s: GBTClassificationModel.load(f"{path}/fold{k}_state{j}") for j, s in enumerate(rest["states"])} for k in range(len(curves))]
    return BoostedModel(rest["cols"], rest["states"], folds, curves, rest.get("cuts"))
