"""The n-gram join against a comparison of all pairs that share an n-gram."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import empty, frame, made

from tracetide.llm import ngram_join


def classes(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def wanted(texts, percent, width):
    return {d: x[:2] for d, x in brute.near_classes(texts, percent, width).items()}


def families(seed, edits):
    """Originals with copies whose words are changed, left out or put in, some by others' edits too, and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    passage, texts = [word() for _ in range(40)], {}
    for _ in range(12):
        own = [word() for _ in range(rng.choice([3, 12, 30, 60, 200]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 14)):
            copy = list(rng.choice([own, texts[rng.choice(list(texts))].split()]) if texts and rng.random() < 0.3 else own)
            for _ in range(rng.randrange(0, edits)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [word()], [copy[k], word()], [copy[k].upper()]])
                copy = copy or ["x"]
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.mark.parametrize(("percent", "n", "edits", "block", "tile"), [(90, 3, 4, 1 << 22, 2048), (80, 2, 6, 1 << 11, 4), (60, 1, 9, 1 << 10, 3)])
def test_classes_are_those_of_all_pairs(spark, percent, n, edits, block, tile):
    texts = families(percent, edits)
    got = ngram_join.similar_texts(frame(spark, texts).repartition(3), n=n, percent=percent, block_bytes=block, tile=tile)
    want = wanted(texts, percent, n)
    assert classes(got.collect()) == want and len({c for _, c in want.values()}) < 0.9 * len(texts)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = ngram_join.op12_ngram_join(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert classes(got.collect()) == wanted({r.doc_id: r.text for r in docs.collect()}, 90, 3)


def test_odd_rows(spark):
    """Null, empty and blank texts, null and repeated ids, clashing columns, no rows, ids that aren't numbers."""
    texts = made(40, 5)
    df = frame(spark, texts).withColumn("gram", F.lit(1)).withColumn("label", F.lit(2))
    assert classes(ngram_join.similar_texts(df, block_bytes=1 << 12).collect()) == wanted(texts, 90, 3)
    assert ngram_join.similar_texts(empty(spark)).count() == 0
    assert classes(ngram_join.similar_texts(df.union(df)).collect()) == wanted(texts, 90, 3)
    rows = ngram_join.similar_texts(df.withColumn("doc_id", F.when(F.col("doc_id") > 20, F.col("doc_id")))).collect()
    assert len(rows) == 40 and sum(r.component_id is None for r in rows) == 21
    blank = ngram_join.similar_texts(frame(spark, {1: None, 2: "", 3: " \n"})).collect()
    assert classes(blank) == {1: (0, 1), 2: (0, 2), 3: (0, 3)}
    with pytest.raises(ValueError):
        ngram_join.similar_texts(df.withColumn("doc_id", F.col("text")))


def test_filters_let_every_similar_pair_pass():
    rng = np.random.default_rng(4)
    for _ in range(300):
        universe = rng.permutation(40)
        a, b = (np.sort(rng.choice(universe, rng.integers(1, 30), replace=False)) for _ in range(2))
        common = np.intersect1d(a, b)
        for percent in (50, 80, 90):
            if 100 * len(common) >= percent * len(np.union1d(a, b)):
                assert len(common) >= ngram_join.least_overlap(len(a), len(b), percent)
                for g in common:
                    i, j = np.searchsorted(a, g), np.searchsorted(b, g)
                    assert ngram_join._fits(np.int64(len(a)), np.int64(len(b)), i, j, percent)
            else:
                assert len(common) < ngram_join.least_overlap(len(a), len(b), percent)
