"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import bound_batches, materialise, mix, ngrams, text_slices, words

FEATURES = ["log_words", "upper", "punctuation", "symbols", "digits", "word_bytes", "distinct_words", "distinct_threes", "top_word", "line_words", "repeated_lines", "shouted_words", "odd_words", "non_ascii", "stops"]
BINS, RIDGE, PASSES = 12, 6e-3, 40
#: Bins of the score from which the prior is read, and the doubt at which its confidence limit is taken.
SCORE_BINS, DOUBT = 1000, 0.1
#: Signs that prose seldom has.
SYMBOLS = b"!|*%&#$@~^<>{}[]\\=+_"
_CLASS = np.zeros((7, 256), bool)
_CLASS[0, 65:91] = True  # upper case
_CLASS[1, [*range(65, 91), *range(97, 123)]] = True  # letters
_CLASS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # punctuation
_CLASS[3, list(SYMBOLS)] = True
_CLASS[4, 48:58] = True  # digits
_CLASS[5, 128:] = True  # other than ASCII
_CLASS[6, [46, 63]] = True  # full stops and question marks


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the commonest) of each row."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])))
    size = np.diff(np.append(cut, len(row)))
    top = np.zeros(n)
    np.maximum.at(top, row[cut], size)
    return np.bincount(row[cut], minlength=n).astype(float), top


def text_features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from the text alone; an empty text has zeros."""
    n = len(offsets) - 1
    sums = np.zeros((7, n))
    for k in range(7):
        total = np.append(0, np.cumsum(_CLASS[k][data]))
        sums[k] = total[offsets[1:]] - total[offsets[:-1]]
    size = np.diff(offsets)
    row, start, end, value = words(offsets, data)
    count = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(count, 1)
    total = [np.append(0, np.cumsum(_CLASS[k][data])) for k in (0, 1, 3, 4)]
    upper, letters, symbols, digits = (t[end] - t[start] for t in total)
    shouted = np.bincount(row, (letters > 1) & (upper == letters), n)
    odd = np.bincount(row, (symbols > 0) | ((digits > 0) & (letters > 0)), n)
    distinct, top = _distinct(row, value, n)
    first, three = ngrams(row, value, 3)
    distinct3, _ = _distinct(row[first], three, n)
    newline = np.append(0, np.cumsum(data == 10))
    line = newline[start] if len(start) else np.zeros(0, np.int64)
    key = np.zeros(len(row), np.int64)
    if len(row):
        cut = np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))
        key = np.cumsum(cut) - 1
        at = np.flatnonzero(cut)
        place = (np.arange(len(row)) - at[key]).astype(np.uint64)
        hashes = np.add.reduceat(mix(value + place * np.uint64(0x9E3779B97F4A7C15)), at)
        lines = np.bincount(row[at], minlength=n).astype(float)
        distinct_lines, _ = _distinct(row[at], hashes, n)
    else:
        lines = distinct_lines = np.zeros(n)
    share = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log2(1 + count), share(sums[0], sums[1]), share(sums[2], size), share(sums[3], size), share(sums[4], size), share(size, some), share(distinct, some), share(distinct3, np.maximum(count - 2, 1)),
        share(top, some), share(count, np.maximum(lines, 1)), share(lines - distinct_lines, lines), share(shouted, some), share(odd, some), share(sums[5], size), share(sums[6], some),
    ])


@dataclass
class QualityModel:
    """Bin borders of each feature, a weight for each bin and a bias; the score is the logistic of their sum."""

    borders: list[np.ndarray]
    weights: np.ndarray
    prior: float
    risk: float

    def bins(self, features: np.ndarray) -> np.ndarray:
        """The column of each feature's bin; the last column is the bias."""
        cols = [np.searchsorted(b, features[:, k], "right") + k * BINS for k, b in enumerate(self.borders)]
        return np.column_stack([*cols, np.full(len(features), len(self.borders) * BINS)])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[self.bins(features)].sum(1), -30, 30)))


@dataclass
class RiskSums:
    """The parts of the risk at some weights: F(0), the maximum's argument, their gradients and curvatures."""

    weights: np.ndarray
    base: float
    argument: float
    base_slope: np.ndarray
    slope: np.ndarray
    base_curve: np.ndarray
    curve: np.ndarray

    def risk(self) -> float:
        return self.base + max(0.0, self.argument)

    def value(self, part: float) -> float:
        return self.base + part * self.argument

    def gradient(self, part: float) -> np.ndarray:
        return self.base_slope + part * self.slope

    def curvature(self, part: float) -> np.ndarray:
        """That of F(part): what the argument takes from the positives' curvature is left out of the base."""
        return (1 - part) * self.base_curve + part * self.curve + RIDGE * np.eye(len(self.weights))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, features array<double>)` of every whole text; null texts count as empty."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_features(offsets, data) for _, offsets, data in text_slices(batch.column(1))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))], names=["id", "features"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(extract, f"id {kind}, features array<double>")


def best_bin(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from counts of both by falling score.

    Above any score the unlabelled hold at least the prior's part of what the positives hold, so the ratio of the
    two shares bounds the prior from above, and is equal to it where no negative scores as high. The ratio is
    read where its own upper confidence limit is least, which keeps away from tails of few rows.
    """
    n_p, n_u = positives.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    q_p, q_u = np.cumsum(positives) / n_p, np.cumsum(unlabelled) / n_u
    some = q_p > 0
    slack = np.sqrt(np.log(4 / DOUBT) / 2) * (n_p**-0.5 + n_u**-0.5)
    limit = np.where(some, (q_u + slack) / np.where(some, q_p, 1), np.inf)
    at = int(np.argmin(limit))
    return float(np.clip(q_u[at] / q_p[at], 1 / (n_u + 2), 1 - 1 / (n_u + 2)))


def estimated_prior(rows: DataFrame, model: QualityModel) -> float:
    """`best_bin` over the scores of `(features, y)`; one row a bin of scores comes to the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.minimum(((1 - sent.value.score(_matrix(batch))) * SCORE_BINS).astype(np.int32), SCORE_BINS - 1)
            positive = batch.column("y").fill_null(-1).to_numpy() == 1
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(positive.astype(np.int64))], names=["bin", "positive"])

    got = rows.select("features", "y").mapInArrow(bins, "bin int, positive long").groupBy("bin").agg(F.sum("positive").alias("p"), F.count(F.lit(1)).alias("u")).orderBy("bin").toPandas()
    return best_bin(got["p"].to_numpy(float), got["u"].to_numpy(float))


def train(features: DataFrame, labels: DataFrame, held_out: Column, label_id: str = "doc_id", label_col: str = "quality", prior: float | None = None) -> QualityModel:
    """Minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) over bin weights.

    features: `(id, features)`; `held_out` is a condition on `id`, and rows that meet it teach nothing. The
    positives are the rows labelled 1, the unlabelled rows are all rows whatever their label; a label 0 teaches
    nothing. Where no `prior` is given it is estimated from the unlabelled text: a first model, with a prior of a
    half, is fitted to the rows whose features hash to one half, and `best_bin` compares how the positives and
    the unlabelled rows of the other half score under it.

    Rows with several labels take the lowest; null labels teach nothing; without positives the prior is a half
    and the weights are flat.
    """
    own = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{label_id}`").alias("__l")).agg(F.min(f"`{label_col}`").alias("y"))
    rows = features.where(~F.coalesce(held_out, F.lit(False))).join(own, features["id"] == own["__l"], "left")
    rows = materialise(rows.select("features", "y", (F.pmod(F.xxhash64("features"), F.lit(2)) == 0).alias("first")), "quality-training")
    positive = (F.col("y") == 1).cast("long")
    counts = rows.agg(F.sum(positive).alias("one"), F.sum(F.when(F.col("first"), positive)).alias("one_first")).first()
    steps = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(F.col("features")[k], steps, 10_000).alias(f"q{k}") for k in range(len(FEATURES))]).first()
    borders = [np.unique(np.array(cuts[k] if cuts[k] is not None else [], float)) for k in range(len(FEATURES))]
    start = QualityModel(borders, np.zeros(len(FEATURES) * BINS + 1), 0.5 if prior is None else prior, 0.0)
    if not counts["one"]:
        return start
    if prior is None and counts["one_first"]:
        start = minimise(rows.where("first"), start)
        start.prior = estimated_prior(rows.where("not first"), start)
    return minimise(rows, start)


def minimise(rows: DataFrame, model: QualityModel) -> QualityModel:
    """The model of least risk under its prior, from its own weights on; rows: `(features, y)`.

    The risk is the larger of F(0) and F(1), F(part) = prior * R+ + part * A + ridge, where A is what the maximum
    is taken of. With the logistic loss R+ is R- less a linear term, so F is convex for every part from 0 to 1.
    Newton steps find the least F(1); if A is negative there, the part falls until A is nought at the least F(part),
    which is where the larger of the two is least. Of all steps the weights of least risk are returned. Every
    step sums over all rows on the executors; gradients and curvatures of a fixed size come to the driver.
    """
    prior, size = model.prior, len(model.weights)
    counts = rows.agg(F.sum((F.col("y") == 1).cast("long")).alias("one"), F.count(F.lit(1)).alias("all")).first()
    n_positive, n_unlabelled = max(1, counts["one"] or 0), max(1, counts["all"])
    cells = 3 + 3 * size + 2 * size * size

    def sums(weights: np.ndarray) -> RiskSums:
        sent = rows.sparkSession.sparkContext.broadcast(QualityModel(model.borders, weights, prior, 0.0))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(cells)
            for batch in batches:
                at = sent.value.bins(_matrix(batch))
                positive = (batch.column("y").fill_null(-1).to_numpy() == 1).astype(float)
                z = np.clip(sent.value.weights[at].sum(1), -30, 30)
                p = 1 / (1 + np.exp(-z))
                minus = np.log1p(np.exp(z))
                out[:3] += (positive * (minus - z)).sum(), (positive * minus).sum(), minus.sum()
                for k, w in enumerate((positive, positive * p, p)):
                    out[3 + k * size : 3 + (k + 1) * size] += np.bincount(at.ravel(), np.repeat(w, at.shape[1]), size)
                x = np.zeros((len(at), size))
                x[np.arange(len(at))[:, None], at] = 1
                curved, own = x * (p * (1 - p))[:, None], np.flatnonzero(positive)
                out[3 + 3 * size :] += np.concatenate([(x.T @ curved).ravel(), (x[own].T @ curved[own]).ravel()])
            keep = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(out[keep])], names=["k", "v"])

        got = rows.mapInArrow(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        sent.destroy()
        out = np.zeros(cells)
        out[got["k"].to_numpy()] = got["v"].to_numpy()
        row, minus, all_minus = out[3 : 3 + 3 * size].reshape(3, size)
        curve_u, curve_p = out[3 + 3 * size :].reshape(2, size, size)
        argument = out[2] / n_unlabelled - prior * out[1] / n_positive
        slope = all_minus / n_unlabelled - prior * minus / n_positive
        ridge = RIDGE / 2 * float(weights @ weights)
        return RiskSums(weights, prior * out[0] / n_positive + ridge, argument, prior * (minus - row) / n_positive + RIDGE * weights, slope, prior * curve_p / n_positive, curve_u / n_unlabelled)

    low, part, high = 0.0, 1.0, 1.0
    now = best = sums(model.weights)
    passes = 1
    while passes < PASSES:
        settled = False
        while not settled and passes < PASSES:
            step, scale = np.linalg.solve(now.curvature(part), now.gradient(part)), 1.0
            settled = True
            while scale > 1e-3 and passes < PASSES:
                after = sums(now.weights - scale * step)
                passes += 1
                best = min(best, after, key=RiskSums.risk)
                if after.value(part) < now.value(part):
                    settled = now.value(part) - after.value(part) < 1e-5 * abs(now.value(part))
                    now = after
                    break
                scale /= 4
        if (part == 1 and now.argument >= 0) or abs(now.argument) < 1e-4 or high - low < 1e-4:
            break
        low, high = (low, part) if now.argument < 0 else (part, high)
        reach = float(now.slope @ np.linalg.solve(now.curvature(part), now.slope))
        part += now.argument / max(reach, 1e-12)
        if not low < part < high:
            part = (low + high) / 2
    return QualityModel(model.borders, best.weights, prior, best.risk())


def score_quality(features: DataFrame, model: QualityModel) -> DataFrame:
    """`(id, score)` of a feature table."""
    sent = features.sparkSession.sparkContext.broadcast(model)
    kind = features.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sent.value.score(_matrix(batch)))], names=["id", "score"])

    return features.select("id", "features").mapInArrow(score, f"id {kind}, score double")


def third(id_col: str) -> Column:
    """Whether a row is held out: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, held_out, score, predicted)` for every row of `docs`; the score is that of label 1.

    Trained on the rows not held out. Null and empty texts are scored by their zero features, repeated rows
    alike; a null id isn't held out and has no label. Other columns are not carried. Empty in, empty out.
    """
    features = materialise(feature_table(docs, id_col, text_col), "quality-features")
    scored = score_quality(features, train(features, labels, third("id")))
    return scored.select(F.col("id").alias(id_col), F.coalesce(third("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
