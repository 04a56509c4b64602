"""Removal of repeated byte strings by a sparse, range-partitioned suffix sort.

Not every suffix is sorted. A string of `width` bytes is assigned to one suffix inside it, the one whose
leading token (a hash of `token` bytes) is smallest; equal strings choose equal suffixes, so comparing
the chosen suffixes compares all strings. About two in `width - token` suffixes are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import NGRAM, bound_batches, materialise, mix, powers, prefix_hash, text_slices

WIDTH, TOKEN = 100, 40
#: Bytes of text whose suffixes meet in one bucket, suffixes sampled for the splitters, most bytes hashed at once.
BUCKET_BYTES, SAMPLE, PIECE = 8 << 20, 50_000, 1 << 20
_LOW = np.uint64((1 << 24) - 1)
#: Numbers for bytes of their own: with a second sum, strings are told apart by 128 bits.
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * NGRAM[62]) | np.uint64(1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def chosen_suffixes(offsets: np.ndarray, data: np.ndarray, width: int, token: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first, count, lead, all, more): runs of strings that share their chosen suffix.

    `first` is the byte in the row at which the first of `count` consecutive strings starts, `lead` the
    leading token (hashed anew, as the smallest hashes of many strings are all small), `all` and `more` hashes of all bytes the run covers and of the suffix's place among them. Long
    data go through in pieces that overlap by one string.
    """
    span = width - token + 1
    for base in range(0, max(1, len(data) - width + 1), PIECE):
        piece = data[base : base + PIECE + width - 1]
        if len(piece) < width:
            continue
        total, inverse = prefix_hash(piece), powers(len(piece) + 1)[1]
        lead = mix((total[token:] - total[:-token]) * inverse[: len(total) - token])
        low = (lead & ~_LOW) | np.arange(len(lead), dtype=np.uint64)
        step = 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        at = (low & _LOW).astype(np.int64)
        start = np.arange(len(at)) + base
        row = np.searchsorted(offsets, start, "right") - 1
        at[start + width > offsets[row + 1]] = -1
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(cut)
        count = np.diff(np.append(cut, len(at)))
        cut, count = cut[at[cut] >= 0], count[at[cut] >= 0]
        suffix, end = at[cut], cut + count - 1 + width
        covered = mix((total[end] - total[cut]) * inverse[cut] + (suffix - cut).astype(np.uint64) * NGRAM[60] + (end - cut).astype(np.uint64) * NGRAM[61])
        second = prefix_hash(piece, _SECOND)
        more = mix((second[end] - second[cut]) * inverse[cut] + (suffix - cut).astype(np.uint64) * NGRAM[61])
        yield row[cut], cut + base - offsets[row[cut]], count, mix(lead[suffix] + NGRAM[33]), covered, more


def _batch_suffixes(batch: pa.RecordBatch, width: int, token: int) -> tuple[np.ndarray, ...]:
    """(lead, all, more, doc, first, count) of a batch of (doc, text)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    parts = [(lead, covered, more, ids[base + row], first, count) for base, offsets, data in text_slices(batch.column(1)) for row, first, count, lead, covered, more in chosen_suffixes(offsets, data, width, token)]
    if not parts:
        return (*[np.zeros(0, np.uint64)] * 3, *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _by_bucket(bucket: np.ndarray, columns: list[tuple[np.ndarray, pa.DataType]], names: list[str]) -> pa.RecordBatch:
    """One row a bucket, with a list for each column: far fewer and smaller rows in the shuffle."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    cuts = np.append(cut, len(bucket))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), *[_lists(v[order], cuts, k) for v, k in columns]], names=names)


class Splitters:
    """Ranges of sorted suffixes: even ones by leading token, computed, and finer ones where the sample is dense.

    A token that many suffixes lead with would fill one range; its sampled suffixes, in order of their
    further bytes and places, split it.
    """

    def __init__(self, sample: np.ndarray, n: int):
        """sample: rows (lead, all, doc), about `SAMPLE` of them."""
        self.even, rows = n, []
        if len(sample) and n > 1:
            lead, counts = np.unique(sample[:, 0], return_counts=True)
            share = max(2, len(sample) // n)
            for hot in lead[counts >= share]:
                own = sample[sample[:, 0] == hot]
                own = own[np.lexsort((own[:, 2], own[:, 1]))]
                rows.append(own[:: max(1, share // 2)])
        table = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), np.uint64)
        self.table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]

    def __len__(self) -> int:
        return self.even + len(self.table)

    def bucket(self, lead: np.ndarray, covered: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The range of each suffix: that of its token, and how many splitters are at or below it."""
        even = (((lead >> np.uint64(32)) * np.uint64(self.even)) >> np.uint64(32)).astype(np.int64)
        out = np.searchsorted(self.table[:, 0], lead, "left")
        tied = np.flatnonzero(np.searchsorted(self.table[:, 0], lead, "right") > out)
        if len(tied):
            keys = [np.concatenate([self.table[:, k], x[tied]]) for k, x in enumerate((lead, covered, doc.astype(np.uint64)))]
            mine = np.append(np.zeros(len(self.table), np.int8), np.ones(len(tied), np.int8))
            order = np.lexsort((mine, keys[2], keys[1], keys[0]))
            below = np.cumsum(mine[order] == 0)
            rank = np.empty(len(order), np.int64)
            rank[order] = below
            out[tied] = rank[len(self.table) :]
        return even + out


def multikey_sort(keys: list[np.ndarray]) -> np.ndarray:
    """Order by several keys: sorts by the first, then only the runs of ties by the next, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    run = np.zeros(len(order), np.int64)
    for k, key in enumerate(keys[1:], 1):
        sorted_key = keys[k - 1][order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        order[tied] = order[tied][np.lexsort((key[order[tied]], run[tied]))]
    return order


def _key_table(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with a distinct long `doc` in the order of documents, and (doc, id) where that isn't the id itself."""
    table = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    whole = dict(table.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and not table.groupBy("id").count().where("count > 1 or id is null or id < 0").limit(1).count():
        return table.select(F.col("id").cast("long").alias("doc"), "text"), None
    ordered = table.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    numbered = materialise(ordered.withColumn("doc", F.monotonically_increasing_id()), "suffix-docs")
    return numbered.select("doc", "text"), numbered.select("doc", "id")


def repeated_spans(table: DataFrame, width: int = WIDTH, token: int = TOKEN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`(doc, first, last)`: byte ranges [first, last) covered by strings that also start earlier.

    table: `(doc long, text)`, documents in the order of `doc`. Ranges may touch or overlap.

    Suffixes go to ranges between splitters, from a sample of at most `SAMPLE` of them, and each range is
    sorted by leading token, by all bytes the suffix stands for, and by place. Of suffixes that agree in all
    bytes all but the first are repeats. Where one leading token has unlike suffixes, or reaches the border
    of a range and may go on behind it, the first of each kind is compared string by string: its strings
    are hashed, dealt by hash, and all but the earliest of equal ones are repeats. Runs and strings are told
    apart by 128 bits of two hashes.
    """
    spark = table.sparkSession
    size = table.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    one_in = max(1, size // (SAMPLE * 640))
    limit = np.uint64(min(2**64 - 1, 2**64 * SAMPLE * one_in * (width - token + 2) // max(1, 2 * size)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, covered, _, doc, first, _ = _batch_suffixes(batch, width, token)
            keep = mix(lead + doc.astype(np.uint64) * NGRAM[0] + first.astype(np.uint64) * NGRAM[1]) < limit
            yield pa.RecordBatch.from_arrays([pa.array(_signed(x[keep])) for x in (lead, covered, doc)], names=["a", "b", "c"])

    got = np.zeros((0, 3), np.uint64)
    if buckets > 1:
        few = table.where(F.pmod(F.xxhash64("doc"), F.lit(one_in)) == 0).mapInArrow(sampled, "a long, b long, c long")
        got = few.toPandas().to_numpy(np.int64).reshape(-1, 3).view(np.uint64)
    splitters = spark.sparkContext.broadcast(Splitters(got, int(buckets)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, covered, more, doc, first, count = _batch_suffixes(batch, width, token)
            at = splitters.value.bucket(lead, covered, doc)
            yield _by_bucket(at, [(_signed(lead), pa.int64()), (_signed(covered), pa.int64()), (_signed(more), pa.int64()), (doc, pa.int64()), (first, pa.int32()), (count, pa.int16())], ["bucket", "lead", "covered", "more", "doc", "first", "count"])

    def sort_bucket(key, rows):
        lead, covered, more, doc, first, count = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("lead", "covered", "more", "doc", "first", "count"))
        order = multikey_sort([lead.view(np.uint64), covered.view(np.uint64), more, doc, first])  # the order of the splitters
        lead, covered, more, doc, first, count = (x[order] for x in (lead, covered, more, doc, first, count))
        new_lead = np.append(True, lead[1:] != lead[:-1])
        new_all = new_lead.copy()
        new_all[1:] |= (covered[1:] != covered[:-1]) | (more[1:] != more[:-1])
        group = np.cumsum(new_lead) - 1
        unlike = np.bincount(group, new_all) > 1
        unlike[[0, -1]] = True
        keep = ~new_all | unlike[group]
        return pa.table({"doc": doc[keep], "first": first[keep].astype(np.int32), "count": count[keep].astype(np.int32), "repeat": ~new_all[keep]})

    dealt = table.mapInArrow(emit, "bucket int, lead array<long>, covered array<long>, more array<long>, doc array<long>, first array<int>, count array<smallint>").repartition(len(splitters.value), "bucket")
    found = materialise(dealt.groupBy("bucket").applyInArrow(sort_bucket, "doc long, first int, count int, repeat boolean"), "suffix-runs")
    whole = found.where("repeat").select("doc", "first", (F.col("first") + F.col("count") - 1 + width).alias("last"))

    asked = found.where("not repeat").groupBy("doc").agg(F.collect_list("first").alias("firsts"), F.collect_list("count").alias("counts"))
    near = table.join(asked, "doc").select("doc", "text", "firsts", "counts")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal strings of a batch the earliest goes on to its bucket, the others are repeats at once."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            firsts, counts = batch.column(2), batch.column(3)
            where, run, length = firsts.offsets.to_numpy(), firsts.flatten().to_numpy(), counts.flatten().to_numpy()
            where = where - where[0]
            for base, offsets, data in text_slices(batch.column(1)):
                for r in range(len(offsets) - 1):
                    a, b = where[base + r], where[base + r + 1]
                    starts = np.repeat(run[a:b] - np.append(0, np.cumsum(length[a:b])[:-1]), length[a:b]) + np.arange(length[a:b].sum())
                    text = data[offsets[r] : offsets[r + 1]]
                    for low in range(0, len(text), PIECE):
                        own = starts[(starts >= low) & (starts < low + PIECE)]
                        total, second = (prefix_hash(text[low : low + PIECE + width], *table) for table in ((), (_SECOND,)))
                        inside = own - low
                        value, more = (mix((x[inside + width] - x[inside]) * powers(len(total))[1][inside]) for x in (total, second))
                        parts.append((value, more, np.full(len(own), ids[base + r]), own))
            if not parts:
                continue
            value, more, doc, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = multikey_sort([value, more, doc, first])
            value, more, doc, first = value[order], more[order], doc[order], first[order]
            new = np.append(True, (value[1:] != value[:-1]) | (more[1:] != more[:-1]))[: len(value)]
            part = ((value >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
            part = np.where(new, part.astype(np.int64), -1 - doc % n_parts)
            yield _by_bucket(part, [(_signed(value), pa.int64()), (_signed(more), pa.int64()), (doc, pa.int64()), (first.astype(np.int32), pa.int32())], ["bucket", "value", "more", "doc", "first"])

    def later(key, rows):
        value, more, doc, first = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("value", "more", "doc", "first"))
        gone = np.ones(len(value), bool)
        if key[0].as_py() >= 0:
            order = multikey_sort([value, more, doc, first])
            value, more, doc, first = value[order], more[order], doc[order], first[order]
            gone[0] = False
            gone[1:] = (value[1:] == value[:-1]) & (more[1:] == more[:-1])
        doc, first = doc[gone], first[gone]
        order = np.lexsort((first, doc))
        doc, first = doc[order], first[order]
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
        last = first[np.append(cut[1:], len(doc)) - 1] + width if len(doc) else first
        return pa.table({"doc": doc[cut], "first": first[cut].astype(np.int32), "last": last.astype(np.int32)})

    n_parts = len(splitters.value)
    single = near.mapInArrow(strings, "bucket int, value array<long>, more array<long>, doc array<long>, first array<int>").repartition(n_parts, "bucket")
    partial = materialise(single.groupBy("bucket").applyInArrow(later, "doc long, first int, last int"), "suffix-strings")
    return whole.unionByName(partial)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, token: int = TOKEN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Removes every byte covered by a string of `width` bytes that also starts earlier.

    Earlier means in a smaller document or at an earlier byte of the same one; strings are judged on the
    input and never cross documents. Returns `id, kept binary, n_bytes, n_removed, n_spans, spans`, the
    last a list of removed `[start, end)`. The bytes left over need not be valid UTF-8.

    Null is the empty text; it, and any text shorter than `width`, comes back whole. Rows that share an id
    are ordered by a hash of their text, null ids come first; equal rows repeat each other. Other columns
    are not carried. An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    table, ids = _key_table(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType
    spans = repeated_spans(table, width, token, bucket_bytes).groupBy("doc").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    spans = materialise(spans, "suffix-spans")
    joined = table.join(spans, "doc", "left").select("doc", "text", "firsts", "lasts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, firsts, lasts in zip(*(batch.column(c) for c in range(4)), strict=True):
                raw = text.as_buffer() if text.is_valid else b""
                raw = memoryview(raw)
                if not firsts.is_valid:
                    out.append((doc.as_py(), bytes(raw), len(raw), 0, []))
                    continue
                a, b = firsts.values.to_numpy(), lasts.values.to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order].astype(np.int64), np.maximum.accumulate(b[order].astype(np.int64))
                new = np.append(True, a[1:] > b[:-1])
                a, b = a[new], b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]
                kept = b"".join(raw[x:y] for x, y in zip(np.append(0, b), np.append(a, len(raw)), strict=True))
                out.append((doc.as_py(), kept, len(raw), len(raw) - len(kept), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))], names=["doc", "kept", "n_bytes", "n_removed", "spans"])

    out = joined.mapInArrow(cut, "doc long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>")
    out = out.withColumn("n_spans", F.size("spans").cast("long"))
    out = out.withColumn(id_col, F.col("doc").cast(kind)) if ids is None else out.join(ids.withColumnRenamed("id", id_col), "doc")
    return out.select(id_col, "kept", "n_bytes", "n_removed", "n_spans", "spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

