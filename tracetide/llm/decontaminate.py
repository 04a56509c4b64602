"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import bound_batches, materialise, ngrams, text_slices, words

SEED = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's words, or this many words, that an alignment must be worth.
SHARE, ENOUGH = 0.5, 50
#: N-grams of the benchmark that are sent to every task (16 MB); beyond it the corpus is joined by shuffle.
BROADCAST_GRAMS = 2_000_000


def _grams(offsets: np.ndarray, data: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of the n-grams of the given sizes."""
    row, _, _, value = words(offsets, data)
    first = np.searchsorted(row, np.arange(len(offsets)))
    parts = [(row[i], i - first[row[i]], g) for i, g in (ngrams(row, value, n) for n in sizes)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of items; an item with fewer than SEED words is one n-gram."""
    for batch in batches:
        ids = batch.column("item").to_numpy()
        for base, offsets, data in text_slices(batch.column("text")):
            count = np.bincount(words(offsets, data)[0], minlength=len(offsets) - 1)
            for n in np.unique(np.minimum(count[count > 0], SEED)).tolist():
                row, at, gram = _grams(offsets, data, [n])
                own = np.minimum(count[row], SEED) == n
                row, at, gram = row[own], at[own], gram[own]
                yield pa.RecordBatch.from_arrays([pa.array(ids[base + row]), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(np.full(len(row), n, np.int32)), pa.array(count[row].astype(np.int32))], names=["item", "at", "gram", "n", "words"])


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, end in text, end in item) of the best local alignment of two sequences of word hashes.

    The row's own gaps are a running maximum, so that a row takes a few vector operations.
    """
    ramp = np.arange(1, len(text) + 1) * GAP
    above, best = np.zeros(len(text) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        row = np.maximum(np.where(text == word, MATCH, MISMATCH) + above[:-1], above[1:] + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row - ramp) + ramp
        above = np.append(0, row)
        top = int(row.argmax())
        if row[top] > best[0]:
            best = int(row[top]), top + 1, i + 1
    return best


def align_span(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best alignment in the text; the start by aligning backwards from its end."""
    score, end, item_end = align(text, item)
    if not score:
        return 0, 0, 0
    _, back, _ = align(text[:end][::-1], item[:item_end][::-1])
    return score, end - back, end


def most(text: np.ndarray, item: np.ndarray) -> int:
    """No alignment of the two scores more: each matched word is found in both."""
    return MATCH * int(min(np.isin(text, item).sum(), np.isin(item, text).sum()))


def needed(n_words: int, share: float = SHARE, enough: int = ENOUGH) -> float:
    """The score an alignment with an item of `n_words` must reach."""
    return MATCH * min(share * n_words, enough)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, enough: int = ENOUGH, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """`(id, item, score, matched, start_word, end_word)` for each document and item that it holds a copy of.

    Words are runs of non-space bytes with A-Z lower-cased. Every word 5-gram of an item is a seed, however
    frequent it is, so any unedited run of five words leads to an alignment. Documents that hold a seed are
    aligned with the item around it (match 2, mismatch -1, gap -1), unless they share too few words there for
    any alignment to be enough. A pair is returned if the score is worth `share` of the
    item's words, or `enough` words; `score` is the share and `matched` the raw score.

    Null and empty texts, and items without words, match nothing. Null ids are ids like others; rows with the
    same id and text are reported once. Other columns are not carried. Either table may be empty.

    The item n-grams go to every task only up to `broadcast_grams` of them; beyond, all n-grams of the
    documents are dealt by hash and joined.
    """
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("doc", F.xxhash64("text"))
    bench = materialise(items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "leak-items")
    grams = materialise(bench.select("item", "text").mapInArrow(_item_grams, "item long, at int, gram long, n int, words int"), "leak-grams")
    sizes = sorted(r[0] for r in grams.select("n").distinct().limit(SEED).collect()) or [SEED]
    known = grams.select("gram").distinct()
    wanted = None
    if known.count() <= broadcast_grams:
        wanted = spark.sparkContext.broadcast(np.sort(known.toPandas()["gram"].to_numpy(np.int64).view(np.uint64)))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, offsets, data in text_slices(batch.column("text")):
                row, at, gram = _grams(offsets, data, sizes)
                if wanted is not None:
                    keys = wanted.value
                    place = np.searchsorted(keys, gram)
                    place[place == len(keys)] = 0
                    hit = np.flatnonzero(keys[place] == gram) if len(keys) else np.zeros(0, np.int64)
                    row, at, gram = row[hit], at[hit], gram[hit]
                take = pa.array(start + row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("doc").take(take), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64))], names=["id", "doc", "pos", "gram"])

    kind = base.schema["id"].dataType.simpleString()
    hits = base.mapInArrow(seeds, f"id {kind}, doc long, pos int, gram long")
    hits = materialise(hits if wanted is not None else hits.join(known, "gram", "left_semi"), "leak-hits")
    shift = (F.col("pos") - F.col("at")).alias("shift")
    pairs = hits.join(grams.select("item", "at", "gram"), "gram").select("id", "doc", "item", shift).groupBy("id", "doc", "item").agg(F.collect_set("shift").alias("shifts"))
    pairs = materialise(pairs.join(bench.select("item", "item_id", F.col("text").alias("item_text")), "item"), "leak-pairs")
    asked = pairs.withColumnsRenamed({"id": "__id", "doc": "__doc"})
    same = base["id"].eqNullSafe(asked["__id"]) & (base["doc"] == asked["__doc"])
    wanted_texts = base.join(asked.select("__id", "__doc").distinct(), same, "left_semi").dropDuplicates(["id", "doc"])  # few texts are moved
    both = wanted_texts.join(asked, wanted_texts["id"].eqNullSafe(asked["__id"]) & (wanted_texts["doc"] == asked["__doc"])).select("id", "text", "item_id", "item_text", "shifts")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(len(batch)):
                text, item = (words(o, d)[3] for name in ("text", "item_text") for _, o, d in text_slices(batch.column(name).slice(k, 1)))
                shifts = np.sort(batch.column("shifts")[k].values.to_numpy())
                slack = len(item) // 2 + 8
                cut = np.append(0, np.flatnonzero(np.diff(shifts) > len(item) + 2 * slack) + 1)
                best, least = (0, 0, 0), needed(len(item), share, enough)
                for a, b in zip(cut, np.append(cut[1:], len(shifts)), strict=True):
                    low, high = max(0, int(shifts[a]) - slack), int(shifts[b - 1]) + len(item) + slack
                    if most(text[low:high], item) < least:
                        continue
                    value, start, end = align_span(text[low:high], item)
                    if value > best[0]:
                        best = value, low + start, low + end
                if best[0] and best[0] >= least:
                    found.append((k, best[0] / (MATCH * len(item)), *best))
            take = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("item_id").take(take), *[pa.array([x[c] for x in found], t) for c, t in ((1, pa.float64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]], names=["id", "item_id", "score", "matched", "start_word", "end_word"])

    item_kind = bench.schema["item_id"].dataType.simpleString()
    out = both.mapInArrow(score, f"id {kind}, item_id {item_kind}, score double, matched int, start_word int, end_word int")
    return out.withColumnsRenamed({"id": id_col, "item_id": item_col})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
