"""Importance resampling towards a target distribution: hashed word features weighed by bit-sliced sums."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import bound_batches, materialise, text_slices

BUCKETS = 10_000
#: Bytes of one text that are looked at together, and of a feature whose checksum is made byte column by byte column.
PORTION, SHORT = 1 << 20, 32
#: Gains are whole thousandths of a nat.
SCALE = 1000
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: Bytes of words once A-Z are lower-cased: 0-9, a-z and all of code points from 128 on.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the reflected polynomial of the common checksum
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of many slices of a byte array: all slices advance by a byte together, long ones go one by one."""
    order = np.argsort(start - end, kind="stable")
    start, size = start[order], (end - start)[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -SHORT, "left"))
    raw = memoryview(np.ascontiguousarray(data))
    crc[:long] = [zlib.crc32(raw[s : s + n]) ^ 0xFFFFFFFF for s, n in zip(start[:long].tolist(), size[:long].tolist(), strict=True)]
    for k in range(SHORT):
        top = int(np.searchsorted(-size, -k, "left"))  # slices longer than k
        if top == long:
            break
        own = crc[long:top]
        crc[long:top] = _CRC[(own ^ data[start[long:top] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = ~crc
    return out


def _portions(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Texts as they are, and one of many bytes cut where a word ends; the flag marks what goes on."""
    if len(data) <= 2 * PORTION:
        yield offsets, data, False
        return
    at = 0
    while at < len(data):
        end = at + PORTION
        while end < len(data) and not (free := np.flatnonzero(~_IN_WORD[_LOWERED[data[end : end + PORTION]]])).size:
            end += PORTION
        end = min(len(data), end + int(free[0])) if end < len(data) else len(data)
        yield np.array([0, end - at]), data[at:end], at > 0
        at = end


def features(column: pa.Array, max_words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket) of every feature and the row of every word, some rows or a portion of a long one at a time."""
    for first, ends, raw in text_slices(column):
        kept = np.zeros(0, np.uint8)
        for offsets, data, goes_on in _portions(ends, raw):
            if not goes_on:
                kept = kept[:0]
            data = _LOWERED[np.concatenate([kept, data])]
            offsets = np.append(0, offsets[1:] + len(kept))
            solid = _IN_WORD[data]
            opens = solid.copy()
            opens[1:] &= ~solid[:-1]
            cuts = offsets[1:-1]
            cuts = cuts[cuts < len(data)]
            opens[cuts] |= solid[cuts]
            at = np.flatnonzero(opens)
            row, before = np.searchsorted(offsets, at, "right") - 1, int(opens[: len(kept)].sum())
            chars, word = np.flatnonzero(solid), (np.cumsum(opens) - 1)[solid]
            line = np.full(len(chars) + len(at), 32, np.uint8)  # the words, with one space after each
            line[np.arange(len(chars)) + word] = data[chars]
            end = np.cumsum(np.bincount(word, minlength=len(at)) + 1) - 1
            start = np.append(0, end[:-1] + 1)[: len(at)]
            rows, found = [], []
            for n in range(1, max_words + 1):
                k = np.arange(max(0, before - n + 1), len(at) - n + 1)
                k = k[row[k] == row[k + n - 1]]
                rows.append(row[k] + first)
                found.append((checksums(line, start[k], end[k + n - 1]) % np.uint32(buckets)).astype(np.int64))
            yield np.concatenate(rows), np.concatenate(found), row[before:] + first
            last = len(at) - max_words + 1  # features of several words may begin before the cut
            kept = np.append(line[start[max(0, last)] :], np.uint8(32))[: len(line) + 1] if max_words > 1 and len(at) else line[:0]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Bit k of every value, packed into 64-bit words: one row for each k."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    wide = np.zeros((bits, -(-values.shape[-1] // 64) * 64), bool)
    wide[:, : values.shape[-1]] = (values >> np.arange(bits)[:, None]) & 1
    return np.packbits(wide, axis=1).view(np.uint64)


def weigh(row: np.ndarray, bucket: np.ndarray, n: int, buckets: int, gains: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of gains over each row's features: a plane of the counts AND a plane of the gains has a bit for each
    bucket with both, and counts for two to the power of their places."""
    plus, minus = gains
    key, count = np.unique(row * buckets + bucket, return_counts=True)
    row, bucket, total = key // buckets, key % buckets, np.zeros(n, np.int64)
    for j in range(int(count.max(initial=0)).bit_length()):
        on = (count >> j) & 1 == 1
        own, at = np.unique(row[on], return_inverse=True)
        wide = np.zeros((len(own), plus.shape[1] * 64), bool)
        wide[at, bucket[on]] = True
        plane = np.packbits(wide, axis=1).view(np.uint64)
        for sign, planes in ((1, plus), (-1, minus)):
            for k, gain in enumerate(planes):
                total[own] += sign * (np.bitwise_count(plane & gain).sum(1, dtype=np.int64) << (j + k))
    return total


def bucket_counts(docs: DataFrame, text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """`(bucket, n)`: how many features of all texts fall into each bucket; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), max_words, buckets):
                total += np.bincount(bucket, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["bucket", "n"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of nats by which a bucket is likelier in the target, each with one more than it has, rounded down."""
    whole, wanted = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = [(float(target.get(b, 0) + 1) * whole) / (float(raw.get(b, 0) + 1) * wanted) for b in range(buckets)]
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], np.int64)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_words: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """`(id, n_features, weight, score, rank)`, one row for each row of `docs`.

    Words are runs of 0-9, a-z and code points from 128 on, A-Z lower-cased; features are runs of up to `max_words`
    words, hashed to buckets by crc32. `weight` adds up the gains of a document's features, `score` adds a
    Gumbel term that rests on seed and id alone. Of the N rows with `min_words` words or more the
    floor(percent * N / 100) with the highest scores are drawn, ties to the smaller id, which is sampling without
    replacement in proportion to the weights; `rank` is their place, null for the others.

    Null and empty texts have no features, weight 0, and are not drawn unless `min_words` is 0. A null id counts as
    the empty string in the seed and comes after all others in ties. Rows that share an id share the
    Gumbel term and are rows of their own; of rows alike in score and id any may come first. Other columns are not
    carried. An empty target or empty `docs` are no error.

    The corpus is counted in partial sums; `buckets` numbers come to the driver and go out again as planes. Ranks
    come from a range-partitioned sort by (drawable, score, id), to which only the sizes of its partitions are added.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    got = [{r["bucket"]: r["n"] for r in bucket_counts(d, c, max_words, buckets).collect()} for d, c in ((docs, text_col), (target, target_col))]
    gain = bucket_gains(*got, buckets)
    planes = bit_planes(np.maximum(gain, 0)), bit_planes(np.maximum(-gain, 0))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            total, size, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, bucket, word in features(batch.column("text"), max_words, buckets):
                if len(row):
                    low, high = int(row.min()), int(row.max()) + 1
                    total[low:high] += weigh(row - low, bucket, high - low, buckets, planes)
                    size[low:high] += np.bincount(row - low, minlength=high - low)
                words += np.bincount(word, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(words), pa.array(total)], names=["id", "n_features", "words", "weight"])

    weighed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(weights, f"id {kind}, n_features long, words long, weight long")
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text_id), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    can = F.col("words") >= min_words
    # the place in the table deals out rows that agree in all else
    scored = materialise(weighed.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), can.alias("can")), "importance-scores").withColumn("place", F.monotonically_increasing_id())
    order = [F.desc("can"), F.desc("score"), F.asc_nulls_last("id"), "place"]
    ordered = materialise(scored.orderBy(*order).drop("place").withColumn("place", F.monotonically_increasing_id()), "importance-ranks")
    part = F.shiftright("place", 33)
    sizes = {r["part"]: (r["n"], r["drawable"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("can").cast("long")).alias("drawable")).collect()}
    before, drawn = [0], percent * sum(n for _, n in sizes.values()) // 100
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, (0, 0))[0])
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), (part + 1).cast("int"))
    rank = start + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("can") & (rank <= drawn), rank).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


ORACLE = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
counted AS (SELECT kind, doc_id, w, count(*) AS k FROM (SELECT kind, doc_id, unnest(words) AS w FROM split) GROUP BY ALL),
byte AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM byte),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(w) * 2, 2),
    lambda p: ('0x' || substr(hex(w), p, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counted), crc),
features AS (SELECT kind, doc_id, bucket, sum(k)::BIGINT AS k FROM counted JOIN hashed USING (w) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(k) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(k) FILTER (WHERE kind = 'b'), 0) AS t FROM features GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM totals),
weights AS (SELECT doc_id, sum(k * g)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE kind = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
