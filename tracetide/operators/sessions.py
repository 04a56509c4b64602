"""Sessions from recordings to states: assembly, features, training, scoring and publishing, many sessions in one plan."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.operators import boosting as bo
from tracetide.operators import features as fe
from tracetide.operators import scoring as sc
from tracetide.operators.blocks import cut
from tracetide.operators.intervals import atomic_segments, bout_purity, merge_equal, overlap_labels
from tracetide.operators.stats import confusion, label_metrics
from tracetide.sources.tables import trimmed

KEY = "session_id"
#: Columns that tell how far an epoch's video can be trusted; kept beside the states and no features.
QUALITY = ["pupil_share", "eyelid_share", "whisk_share", "off_share", "camera_off_epoch"]
EYE = ["diameter", "motion", "eyelid", "eyelid_norm"]


@dataclass(frozen=True)
class Plan:
    """How sessions are cut, described and decoded; seconds and Hz."""

    fs: float
    fs_frames: float = 10.0
    epoch_s: float = 1.0
    states: tuple[str, ...] = ("NREM", "REM", "Wake")
    min_share: float = 0.0
    context: tuple[str, ...] = ("log_delta_4s", "log_theta_4s", "diam_mean", "motion_mean")
    context_windows: tuple[int, ...] = (5, 15, 60)
    median_s: dict = field(default_factory=lambda: {"NREM": 60.0, "REM": 80.0, "Wake": 40.0})
    sigma: dict = field(default_factory=lambda: {"NREM": 1.0, "REM": 0.8, "Wake": 1.2})
    longest_s: float = 450.0
    force: str | None = None  # a state that epochs take wherever its probability reaches the threshold
    threshold: float = 0.8

    def durations(self) -> sc.Durations:
        return sc.Durations.build(list(self.states), self.median_s, self.sigma, self.epoch_s, self.longest_s)


class Session(NamedTuple):
    samples: DataFrame
    frames: DataFrame


class Scored(NamedTuple):
    epochs: DataFrame
    bouts: DataFrame


def assemble(voltage: DataFrame, eye: DataFrame, whisking: DataFrame, bounds: DataFrame | None = None) -> Session:
    """Samples and frames of sessions.

    voltage: `session_id, t, value`, kept within `bounds(session_id, t0, t1)`, whose nulls are open; the video isn't cut.
    Frames take their time from the whisking clock, `session_id, frame, t, whisking`; eye: `session_id, frame` and the
    measures, whose likelihoods are 1 where there are none. Frames that one of the two lacks are left out.
    """
    samples = voltage if bounds is None else trimmed(voltage, bounds, [KEY], "t")
    likely = {c: F.coalesce(F.col(c).cast("double"), F.lit(1.0)) if c in eye.columns else F.lit(1.0) for c in ("pup_likelihood", "lid_likelihood")}
    seen = eye.select(KEY, "frame", *[F.col(c).cast("double").alias(c) for c in EYE], *[v.alias(c) for c, v in likely.items()])
    return Session(samples.select(KEY, "t", "value"), whisking.select(KEY, "frame", "t", "whisking").join(seen, [KEY, "frame"]))


def session_epochs(session: Session, epoch_s: float) -> DataFrame:
    """`session_id, epoch_idx, e_start, e_end` over the time that samples and frames both cover."""
    spans = [d.groupBy(KEY).agg(F.min("t").alias("t0"), F.max("t").alias("t1")) for d in session]
    both = spans[0].unionByName(spans[1])
    known = both.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(KEY)
    return sc.epoch_grid(both.join(known, KEY), epoch_s, KEY)


def session_features(session: Session, plan: Plan) -> DataFrame:
    """All features of every epoch, those of its neighbourhood, and quality columns; features are complete and scaled
    within their session. The table of epochs is a checkpoint, as medians and scaling read it again, and so is the result, as
    labels, training and scoring each read it."""
    frames = sc.video_masks(session.frames, KEY)
    table = cut(fe.feature_table(session_epochs(session, plan.epoch_s), session.samples, frames, KEY, plan.fs, plan.fs_frames, plan.epoch_s))
    table = sc.context_features(table, KEY, [c for c in plan.context if c in table.columns], plan.context_windows)
    cols = feature_columns(table)
    return cut(sc.robust_scale(sc.impute(table, KEY, cols), KEY, cols))


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in (KEY, "epoch_idx", "e_start", "e_end", "label", "row_id", *QUALITY)]


def train_sessions(session: Session, labels: DataFrame, plan: Plan, drop_artifact: bool = False, folds: int = 3, rounds: int = 20, threads: int = 4, features: DataFrame | None = None) -> bo.BoostedModel:
    """A boosted model of the epochs that `labels(session_id, label, l_start, l_end)` label; all states must occur.
    `features` are those of `session_features`, if they are there already."""
    known, _ = sc.standard_labels(labels, drop_artifact=drop_artifact)
    table = session_features(session, plan) if features is None else features
    told = overlap_labels(table.select(KEY, "epoch_idx", "e_start", "e_end"), known.where(F.col("label").isin(*plan.states)), plan.min_share, [KEY], max(1, round(24 * plan.epoch_s))).where("label is not null")
    rows = cut(table.join(told.select(KEY, "epoch_idx", "label"), [KEY, "epoch_idx"]).withColumn("row_id", F.xxhash64(KEY, "epoch_idx")))
    return bo.train_boosted(rows, feature_columns(table), list(plan.states), folds=folds, rounds=rounds, threads=threads)


def score_sessions(session: Session, model: bo.BoostedModel, plan: Plan, features: DataFrame | None = None) -> Scored:
    """Epoch and bout tables of all sessions in one lineage: features, probabilities, decoding, runs.

    `epochs`: session_id, epoch_idx, start_s, end_s, pred_label, P_<state>, quality. `bouts`: session_id, start_s, end_s,
    label, n_epochs and the means of probabilities and quality.
    """
    table = session_features(session, plan) if features is None else features
    lacking = sorted(set(model.cols) - set(table.columns))
    if lacking:
        raise ValueError(f"features are missing: {lacking}")
    p = [f"P_{s}" for s in plan.states]
    judged = cut(bo.boosted_probabilities(table, model).select(KEY, F.col("epoch_idx").cast("long").alias("epoch_idx"), F.col("e_start").alias("start_s"), F.col("e_end").alias("end_s"), *p, *QUALITY))
    path = sc.decode_sessions(judged, plan.durations(), KEY).withColumnRenamed("state", "pred_label")
    epochs = judged.join(path, [KEY, "epoch_idx"])
    if plan.force:
        epochs = sc.force_state(epochs, "pred_label", plan.force, plan.threshold)
    w = W.partitionBy(KEY).orderBy("epoch_idx")
    run = F.sum((~F.col("pred_label").eqNullSafe(F.lag("pred_label").over(w))).cast("int")).over(w)
    by = epochs.withColumn("__run", run).groupBy(KEY, "__run", F.col("pred_label").alias("label"))
    bouts = by.agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n_epochs"), *[F.avg(c).alias(f"mean_{c}") for c in (*p, *QUALITY)])
    return Scored(epochs.select(KEY, "epoch_idx", "start_s", "end_s", "pred_label", *p, *QUALITY), bouts.select(KEY, "start_s", "end_s", "label", "n_epochs", *[f"mean_{c}" for c in (*p, *QUALITY)]))


def hypnograms(scored: Scored, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Two interval tables `session_id, state, start_time, end_time`, neighbours of one state joined: from the decoded
    bouts, and from each epoch's likeliest state."""
    bouts = scored.bouts.select(KEY, F.col("label").alias("state"), F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"))
    likely = sc.argmax_label(scored.epochs, list(plan.states), "state").select(KEY, "state", F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"))
    return tuple(merge_equal(d, [KEY]).select(KEY, "state", "start_time", "end_time") for d in (bouts, likely))


class Evaluation(NamedTuple):
    epoch_metrics: DataFrame
    bout_metrics: DataFrame
    epoch_mismatches: DataFrame
    bout_mismatches: DataFrame
    purity: DataFrame


def evaluate_sessions(scored: Scored, labels: DataFrame, plan: Plan) -> Evaluation:
    """Scores against labels, `session_id, label, l_start, l_end`, of the sessions that have some.

    By epoch: each epoch's likeliest state, before decoding, against the label it overlaps longest. By bout: decoded
    bouts against labels, neighbours of one state joined, cut at every boundary and weighted by duration. Metrics are
    precision, recall, F1 and support per session and state with the session's accuracy; mismatches are the epochs
    and the pieces of time that differ; `purity` is each predicted bout's main label and its share.
    """
    known, _ = sc.standard_labels(labels)
    known = known.where(F.col("label").isin(*plan.states))
    truth = merge_equal(known.select(KEY, F.col("label").alias("state"), F.col("l_start").alias("start_time"), F.col("l_end").alias("end_time")), [KEY])
    epochs = sc.argmax_label(scored.epochs, list(plan.states), "likely").withColumnsRenamed({"start_s": "e_start", "end_s": "e_end"})
    both = overlap_labels(epochs, known, plan.min_share, [KEY], max(1, round(24 * plan.epoch_s))).where("label is not null")
    bouts = scored.bouts.select(KEY, F.col("label").alias("state"), F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"))
    pieces = atomic_segments(truth, bouts, [KEY])
    return Evaluation(
        label_metrics(confusion(both, "label", "likely", keys=[KEY]), [KEY]),
        label_metrics(confusion(pieces, "a_state", "b_state", F.col("duration"), [KEY]), [KEY]),
        both.where("label <> likely").select(KEY, F.col("e_start").alias("start_s"), F.col("e_end").alias("end_s"), F.col("label").alias("true_label"), F.col("likely").alias("max_label")),
        pieces.where("a_state <> b_state").select(KEY, F.col("t").alias("start_s"), F.col("t2").alias("end_s"), F.col("duration").alias("duration_s"), F.col("a_state").alias("true_label"), F.col("b_state").alias("pred_label")),
        bout_purity(pieces, [KEY]),
    )


# --- publishing ----------------------------------------------------------------------------------


def signature(model: bo.BoostedModel, plan: Plan) -> str:
    """A mark of everything that scores depend on: features, their bins, trees, calibrators and the plan."""
    trees = [[fold[s].toDebugString for s in model.states] for fold in model.folds]
    parts = json.dumps([model.cols, model.cuts, model.states, model.curves, asdict(plan)], sort_keys=True) + "".join(t.split("\n", 1)[1] for fold in trees for one in fold for t in [one])
    return hashlib.sha256(parts.encode()).hexdigest()[:24]


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _latest(spark: SparkSession, out: str) -> str | None:
    fs, at = _folder(spark, f"{out}/current")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    done = [n for n in names if n.startswith("n")]
    return done[-1] if done else None


def published(spark: SparkSession, out: str) -> DataFrame | None:
    """`session_id, signature, version, n_epochs, n_bouts, status` of the sessions that are published; None before the first."""
    name = _latest(spark, out)
    return spark.read.parquet(f"{out}/current/{name}") if name else None


def read_scores(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The published `epochs`, `bouts`, `bout_states` or `epoch_states` of every session, each from its own version."""
    now = published(spark, out)
    if now is None:
        raise ValueError(f"nothing is published under {out}")
    return spark.read.option("basePath", f"{out}/versions").parquet(f"{out}/versions/*/{table}").join(now.select(KEY, "version"), [KEY, "version"])


def publish_scores(spark: SparkSession, session: Session, model: bo.BoostedModel, plan: Plan, out: str, force: bool = False) -> DataFrame:
    """Scores the sessions whose published scores have another signature or none, and returns a summary row for each
    session of the input: `session_id, status (scored or kept), n_epochs, n_bouts`.

    All tables of a run go to a version of their own; older versions stay as they are, as the archive. What is current
    is one small table, written under another name and put in place by a rename, so readers see the old or the new.
    """
    mark, version, before = signature(model, plan), f"version={uuid.uuid4().hex}", published(spark, out)
    every = session.samples.select(KEY).distinct().join(session.frames.select(KEY).distinct(), KEY)
    same = before.where(F.lit(not force) & (F.col("signature") == mark)).select(KEY) if before is not None else every.where(F.lit(False))
    todo = every.join(same, KEY, "left_anti")
    if todo.limit(1).count():
        own = Session(*(d.join(todo, KEY, "left_semi") for d in session))
        scored = score_sessions(own, model, plan)
        path = f"{out}/versions/{version}"
        scored.epochs.write.parquet(f"{path}/epochs")
        stored = spark.read.parquet(f"{path}/epochs")
        scored.bouts.write.parquet(f"{path}/bouts")
        stored = Scored(stored, spark.read.parquet(f"{path}/bouts"))
        for name, states in zip(("bout_states", "epoch_states"), hypnograms(stored, plan), strict=True):
            states.write.parquet(f"{path}/{name}")
        n = stored.epochs.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_epochs")).join(stored.bouts.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_bouts")), KEY, "left")
        fresh = todo.join(n, KEY, "left").select(KEY, F.lit(mark).alias("signature"), F.lit(version.partition("=")[2]).alias("version"), F.coalesce("n_epochs", F.lit(0)).cast("long").alias("n_epochs"), F.coalesce("n_bouts", F.lit(0)).cast("long").alias("n_bouts"))
        kept = before.join(todo, KEY, "left_anti") if before is not None else fresh.where(F.lit(False))
        name = f"n{int((_latest(spark, out) or 'n0')[1:]) + 1:09d}"
        kept.unionByName(fresh).write.parquet(f"{out}/making-{version.partition('=')[2]}")
        fs, target = _folder(spark, f"{out}/current/{name}")
        fs.mkdirs(target.getParent())
        if not fs.rename(_folder(spark, f"{out}/making-{version.partition('=')[2]}")[1], target):
            raise RuntimeError(f"{out}/current/{name} could not be put in place")
    now = published(spark, out)
    status = F.when(F.col("version") == version.partition("=")[2], "scored").otherwise("kept")
    return every.join(now, KEY).select(KEY, status.alias("status"), "n_epochs", "n_bouts")
