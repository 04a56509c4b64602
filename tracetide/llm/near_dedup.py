"""Near-duplicate classes by one-permutation MinHash, bands and star-shaped candidate edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.llm.shared import NGRAM, bound_batches, connected_components, discard, materialise, mix, ngrams, text_slices, words

SLOTS, ROWS, SHINGLE, TURNS = 128, 4, 5, 4
BANDS = SLOTS // ROWS
#: Sets of up to this size also meet by shingles that two similar ones can't but share.
SHORT = 40
#: Rows and shingles of a bucket that meet in one comparison; a larger bucket is compared tile by tile.
TILE_ROWS, TILE_SHINGLES = 2048, 1 << 20
#: Copies of the smallest id of equal sets, over which a large group of them is dealt.
SALTS = 16
_BITS = 7
_EDGES = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - _BITS)
_PROBES = 4096
_PROBE = (mix(np.arange(SLOTS * _PROBES, dtype=np.uint64)) % np.uint64(SLOTS)).astype(np.int64).reshape(_PROBES, SLOTS)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a shorter row is one shingle, an empty one has none."""
    row, _, _, value = words(offsets, data)
    index, gram = ngrams(row, value, n)
    rows = np.arange(len(offsets))
    at, to = np.searchsorted(row[index], rows), np.searchsorted(row, rows)
    out = []
    for r in range(len(offsets) - 1):
        own = value[to[r] : to[r + 1]]
        if at[r + 1] > at[r]:
            out.append(np.unique(gram[at[r] : at[r + 1]]))
        elif len(own):
            out.append(mix(np.array([(own * NGRAM[: len(own)]).sum() + np.uint64(len(own))], np.uint64)))
        else:
            out.append(own)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One hash a shingle: its high bits choose the slot, the smallest stays. An empty slot takes the value of
    the first filled one in its own random order of slots (optimal densification)."""
    at = np.searchsorted(shingles, _EDGES)
    full = np.append(at[1:], len(shingles)) > at
    out = np.zeros(SLOTS, np.uint64)
    out[full] = shingles[at[full]]
    empty, k = np.flatnonzero(~full), 0
    while len(empty):
        if k == _PROBES:
            out[empty] = shingles[0]
            break
        probe = _PROBE[k, empty]
        hit = full[probe]
        out[empty[hit]] = out[probe[hit]]
        empty, k = empty[~hit], k + 1
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def least_agreement(percent: int) -> int:
    """Slots that signatures of similar documents share but for a chance below 1e-10."""
    p, tail, k = percent / 100, 0.0, -1
    while tail < 1e-10 and k < SLOTS:
        k += 1
        tail += math.comb(SLOTS, k) * p**k * (1 - p) ** (SLOTS - k)
    return k


def _signatures(percent: int):
    """Set sizes, two sums that tell sets apart, signatures and, of short sets, a prefix.

    Of two sets that overlap by `percent` % the n - ceil(n * percent / 100) + 1 smallest shingles of either hold a
    common one.
    """

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, sigs, prefixes = [], [], [], [], []
            for _, offsets, data in text_slices(batch.column("text")):
                for shingles in shingle_sets(offsets, data):
                    n = len(shingles)
                    sizes.append(n)
                    ones.append(shingles.sum(dtype=np.uint64) if n else np.uint64(0))
                    twos.append(mix(shingles ^ NGRAM[50]).sum(dtype=np.uint64) if n else np.uint64(0))
                    sigs.append(signature(shingles).tobytes() if n else None)
                    prefixes.append(shingles[: n + (-percent * n) // 100 + 1].view(np.int64) if 0 < n * percent <= 100 * SHORT else ())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(np.array(ones, np.uint64).view(np.int64), pa.int64()), pa.array(np.array(twos, np.uint64).view(np.int64), pa.int64()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc", "n", "h1", "h2", "sig", "prefix"])

    return signatures


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        slots = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = mix((slots * NGRAM[:ROWS]).sum(2) + np.arange(1, BANDS + 1, dtype=np.uint64) * NGRAM[40])
        doc, n, prefix = batch.column("doc").to_numpy(), batch.column("n").to_numpy(), batch.column("prefix")
        short = prefix.flatten().to_numpy().view(np.uint64)
        key, band = np.append(key.ravel(), mix(short ^ NGRAM[51])), np.append(np.tile(np.arange(BANDS), len(batch)), np.full(len(short), BANDS))
        own = np.append(np.repeat(np.arange(len(batch)), BANDS), np.repeat(np.arange(len(batch)), prefix.value_lengths().to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(band, pa.int32()), pa.array(doc[own]), pa.array(n[own])], names=["bucket", "band", "doc", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for _, offsets, data in text_slices(batch.column("text")) for s in shingle_sets(offsets, data)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "shingles"])


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("one"), batch.column("two"), strict=True)):
                keep[k] = _overlap(*(np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y)), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return confirm


def _agreeing(least: int):
    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SLOTS) for c in ("one", "two"))
                yield batch.select(["a", "b"]).filter(pa.array(((one == two).sum(1) >= least) | batch.column("short").to_numpy(zero_copy_only=False)))

    return agreeing


def _meeting(rows: pa.Table, percent: int, least: int) -> list[tuple[int, int]]:
    """Links between the classes of two tiles of a bucket (or within one), enough to join all that hang together.

    Every pair of different classes is looked at in the first band it has in common, unless links found here
    have joined the classes already.
    """
    doc, label, n, tile = (rows.column(c).to_numpy() for c in ("doc", "label", "n", "tile"))
    if label.min() == label.max():
        return []
    band, across = rows.column("band")[0].as_py(), rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
    parent = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, step = [], max(1, (1 << 25) // (SLOTS * len(doc)))
    for top in range(0, len(doc), step):
        i = np.arange(top, min(len(doc), top + step))
        maybe = (i[:, None] < np.arange(len(doc))) & (label[i, None] != label) & (100 * np.minimum(n[i, None], n) >= percent * np.maximum(n[i, None], n))
        if across:
            maybe &= tile[i, None] != tile
        same = sig[i, None] == sig[None]
        short = np.minimum(n[i, None], n) <= SHORT
        maybe &= (same.sum((2, 3)) >= least) | short
        if band < BANDS:
            maybe &= same.all(3).argmax(2) == band
        for x, y in np.argwhere(maybe).tolist():
            x += top
            a, b = root(label[x].item()), root(label[y].item())
            if a != b and _overlap(sets[x], sets[y], percent):
                parent[a] = b
                out.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
    return out


def _overlap(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum()) if len(y) else 0
    return 100 * common >= percent * (len(x) + len(y) - common)


def _compared(percent: int, least: int):
    """Rows sorted by bucket and tiles: the links of each group, which may go on over batches."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: pa.Table) -> pa.RecordBatch:
            found = np.array(_meeting(group, percent, least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if len(rows) else []
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield links(rows.slice(a, b - a).combine_chunks())
            held = rows.slice(cuts[-1]) if len(cuts) else rows
        if held is not None and len(held):
            yield links(held.combine_chunks())

    return compared


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """`(id, n_shingles, component_id, kept)`, one row for each row of `docs`.

    Documents whose sets of five-word shingles overlap by at least `percent` % of their union are linked, and
    a class is what links connect. `component_id` is the smallest id of the class, `kept` says whether
    that is the document's own. A text with fewer than five words is one shingle; null and empty texts have
    none and stay alone. Ids are longs and should be distinct; rows that share an id share its class, and
    rows with a null id stay alone with a null class. Other columns are not carried. Empty in, empty out.

    Equal sets are merged first. The representatives go to 32 buckets, by bands of four of 128 slots; at 85 %
    a pair of large sets misses all of them with a chance of 6e-11, and sets of up to SHORT shingles also meet by
    a prefix that two similar sets can't but share. In a bucket every member gets one edge to its centre,
    the member with the most crowded buckets altogether, which keeps the edges linear in the rows. Edges are
    confirmed on whole sets. In buckets that still hold several classes all pairs of different classes are
    compared, tile by tile, and only links that join classes come out: a quarter of the bands at a time, with the
    classes known by then. So no link between candidates is lost.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be whole numbers, not {kind.simpleString()}")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    all_sigs = materialise(base.mapInArrow(_signatures(percent), "doc long, n long, h1 long, h2 long, sig binary, prefix array<long>"), "near-signatures")
    known = all_sigs.where("doc is not null and n > 0")
    equal = materialise(known.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-equal")
    reps = known.join(equal.select(F.col("rep").alias("doc"), "h1", "h2", "n"), ["doc", "h1", "h2", "n"], "left_semi").select("doc", "n", "sig", "prefix").dropDuplicates(["doc"])

    rows = materialise(reps.mapInArrow(_bands, "bucket long, band int, doc long, n long"), "near-bands")
    crowd = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = materialise(rows.join(crowd, "bucket"), "near-crowded")
    discard(rows)
    score = crowded.groupBy("doc").agg(F.round(F.sum(F.log("size")), 6).alias("score"))
    ranked = crowded.select("bucket", "doc").join(score, "doc")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("doc")).alias("doc"))).alias("top")).select("bucket", (-F.col("top.doc")).alias("centre"))
    stars = crowded.join(centre, "bucket").where("doc <> centre").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b"))
    sigs = materialise(known.select("doc", "n", "h1", "h2", "sig").join(equal.select(F.col("rep").alias("doc"), "h1", "h2", "n"), ["doc", "h1", "h2", "n"], "left_semi").dropDuplicates(["doc"]).join(crowded.select("doc").distinct(), "doc", "left_semi").select("doc", "n", "sig"), "near-crowded-signatures")
    asked = sigs.select("doc").hint("merge")
    sets = materialise(base.join(asked, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(_sets, "doc long, shingles binary"), "near-sets")

    links = _links(sets, sigs, stars, percent)
    labels = connected_components(links)
    for turn in range(TURNS):
        more = _exact_rest(crowded.where(F.col("band") % TURNS == turn).drop("size"), labels, sets, sigs, percent)
        if more.limit(1).count():
            labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    copied = equal.where("copies > 1").join(labels, equal.rep == labels.node, "left").select("h1", "h2", "n", F.coalesce("label", "rep").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = all_sigs.select("doc", "n", "h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")).join(copied, ["h1", "h2", "n", "salt"], "left").join(labels, F.col("doc") == labels.node, "left")
    one = F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.coalesce("own", "label", "doc")).otherwise(F.col("doc"))
    component = F.min(one).over(W.partitionBy("doc"))
    out = out.select("doc", "n", component.alias("component"))
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def _exact_rest(own: DataFrame, labels: DataFrame, sets: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """`(a, b)`: links between classes that meet in a bucket. A large bucket is dealt into tiles of bounded size,
    and every two tiles meet in one comparison."""
    state = own.join(labels, own.doc == labels.node, "left").select("bucket", "band", "doc", "n", F.coalesce("label", "doc").alias("label"))
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("n") / TILE_SHINGLES)).cast("int")
    mixed = state.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), tiles.alias("tiles")).where("least < most").select("bucket", "tiles")
    rows = state.join(mixed, "bucket").withColumn("tile", F.pmod(F.xxhash64("doc"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "band", "doc", "n", "label")
    whole = rows.join(sigs.select("doc", "sig"), "doc").join(sets, "doc").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return materialise(whole.select("bucket", "low", "high", "tile", "band", "doc", "n", "label", "sig", "shingles").mapInArrow(_compared(percent, least_agreement(percent)), "a long, b long"), "near-links")


def _links(sets: DataFrame, sigs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets overlap enough; sizes and signatures rule out most others beforehand."""
    one = sigs.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sig").alias("one"))
    two = sigs.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("two"))
    near = pairs.distinct().join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = materialise(near.select("a", "b", "one", "two", (F.least("na", "nb") <= SHORT).alias("short")).mapInArrow(_agreeing(least_agreement(percent)), "a long, b long"), "near-pairs")
    both = near.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("two")), "b")
    return materialise(both.select("a", "b", "one", "two").mapInArrow(_confirm(percent), "a long, b long"), "near-links")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
