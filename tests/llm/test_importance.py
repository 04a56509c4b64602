"""Importance resampling against dictionaries of words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import empty, frame, made

from tracetide.llm import importance


def counted(text, max_words=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), Counter(" ".join(words[i : i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1))


def drawn(texts, target, percent, min_words, max_words, buckets, seed):
    """{id: (features, weight, score, rank)} from the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    sums = []
    for group in (texts.values(), target):
        own = Counter()
        for t in group:
            for f, n in counted(t, max_words)[1].items():
                own[bucket(f)] += n
        sums.append(own)
    s, t = sums
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = {}
    for d, text in texts.items():
        words, own = counted(text, max_words)
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[bucket(f)] for f, n in own.items())
        out[d] = (own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= min_words)
    able = sorted((d for d in out if out[d][3]), key=lambda d: (-out[d][2], d))
    rank = {d: k + 1 for k, d in enumerate(able[: percent * len(able) // 100])}
    return {d: (*x[:3], rank.get(d)) for d, x in out.items()}


@pytest.mark.parametrize(("percent", "min_words", "max_words", "buckets", "portion"), [(10, 20, 1, 10_000, 1 << 20), (50, 1, 2, 64, 1 << 20), (30, 3, 3, 100, 50), (100, 0, 1, 7, 64)])
def test_draws_are_those_of_dictionaries(spark, monkeypatch, percent, min_words, max_words, buckets, portion):
    texts = made(70, 13) | {200: "é1 É A.b" * 9, 201: "x" * 200 + " " + "y" * 33 + " the", 202: "the " * 3000}
    target = ["the of erat 1 2 3", None, "", "onin Therlyha the " * 40]
    monkeypatch.setattr(importance, "PORTION", portion)
    for text in texts.values():  # portions of a long text give what the whole gives
        found = Counter(b for _, bucket, _ in importance.features(pa.array([text]), max_words, buckets) for b in bucket.tolist())
        want = Counter()
        for f, n in counted(text, max_words)[1].items():
            want[zlib.crc32(f.encode()) % buckets] += n
        assert found == want
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame(spark, texts).repartition(5), goal, percent, min_words, max_words, buckets, 77)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got.collect()} == drawn(texts, target, percent, min_words, max_words, buckets, 77)


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(1)
    gain = rng.integers(-40_000, 40_000, 1000)
    row, bucket = rng.integers(0, 9, 50_000), rng.integers(0, 1000, 50_000) ** 2 // 1000
    planes = importance.bit_planes(np.maximum(gain, 0)), importance.bit_planes(np.maximum(-gain, 0))
    assert importance.weigh(row, bucket, 10, 1000, planes).tolist() == np.bincount(row, gain[bucket], 10).astype(np.int64).tolist()
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    start = np.array([0, 5, 5, 100, 400, 0, 7])
    end = np.array([0, 6, 37, 133, 432, 500, 40])
    assert importance.checksums(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_odd_rows(spark):
    """No rows, no target, null and repeated ids, ties."""
    goal = frame(spark, {0: "a b c"})
    assert importance.resample(empty(spark), goal).count() == 0
    assert {r.weight for r in importance.resample(frame(spark, {1: "a", 2: None}), empty(spark), min_words=0).collect() if r.doc_id == 2} == {0}
    df = frame(spark, {d: "same words " * 15 for d in range(40)})
    twice = importance.resample(df.union(df), goal, percent=50).collect()
    ranks = sorted(r["rank"] for r in twice if r["rank"])
    assert len(twice) == 80 and ranks == list(range(1, 41))
    nulls = importance.resample(df.withColumn("doc_id", F.when(F.col("doc_id") < 20, F.col("doc_id"))), goal, percent=100).collect()
    assert sorted(r["rank"] for r in nulls) == list(range(1, 41)) and len({r.score for r in nulls if r.doc_id is None}) == 1
    assert [c for c in importance.resample(df, goal).columns] == ["doc_id", "n_features", "weight", "score", "rank"]
