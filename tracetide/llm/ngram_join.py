"""A self-join of texts by the Jaccard similarity of their word n-grams: rare-first prefixes, filters, one verification.

Texts are dealt into blocks of bounded size. Each block asks, for the fingerprints of its n-grams, in how many
texts of the corpus they are found; the answers put every text's n-grams into one order, rarest first. Two
similar texts must share one of the first few, and n-grams found in one text only can be shared by none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.llm.shared import NGRAM, bound_batches, connected_components, discard, materialise, mix, ngrams, text_slices, words
from tracetide.llm.suffix_lm import pack, unpack

WORDS = 3
#: Bytes of a block of texts, and what a row counts for beside its text.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 32
#: Bits of the fingerprints that are counted; two n-grams that share one are ordered as if more frequent.
BITS = 40
#: Parts into which a set is divided by hash; the sizes of the parts bound the overlap.
PARTS = 32
#: Rows of a bucket that meet in one comparison; a larger one is compared tile by tile.
TILE = 2048
#: Copies of the smallest id of equal sets, over which a large group of them is dealt.
SALTS = 16


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) for every distinct n-gram of each row, sorted; fewer than n words are one n-gram."""
    rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, offsets, data in text_slices(column):
        row, _, _, value = words(offsets, data)
        index, gram = ngrams(row, value, n)
        rows.append(row[index] + first)
        grams.append(gram)
        size = np.bincount(row, minlength=len(offsets) - 1)
        few, at = np.flatnonzero((size > 0) & (size < n)), np.append(0, np.cumsum(size))
        rows.append(few + first)
        grams.append(mix(np.array([(value[at[r] : at[r + 1]] * NGRAM[: size[r]]).sum() + np.uint64(size[r]) for r in few], np.uint64)))
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))[: len(row)]
    return row[new], gram[new]


def _sums(row: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums that tell a set from others, for each row."""
    size = np.bincount(row, minlength=rows)
    at = np.append(0, np.cumsum(size))
    total = [np.append(np.uint64(0), np.cumsum(x)) for x in (gram, mix(gram ^ NGRAM[50]))]
    return size, *((t[at[1:]] - t[at[:-1]]).view(np.int64) for t in total)


def _counted(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(gram >> np.uint64(64 - BITS), return_inverse=True, return_counts=True)


def _rarity(n: np.ndarray) -> np.ndarray:
    """A byte that grows with the count: exact up to 191, then by steps of a fifth."""
    return np.where(n < 192, n, np.minimum(255, 192 + np.floor(4 * np.log2(np.maximum(n, 1) / 192)))).astype(np.uint8)


def _count(rows: pa.Table) -> pa.Table:
    """How rare the fingerprints of one bucket are, for each block in the order in which it asked."""
    asked = [unpack(x, (np.uint64, np.int32)) for x in rows.column("data")]
    prints, counts = (np.concatenate(x) for x in ([np.cumsum(p) for p, _ in asked], [c for _, c in asked]))
    _, back = np.unique(prints, return_inverse=True)
    rarity = _rarity(np.bincount(back, counts))[back]
    told = [pack([x], [np.uint8]) for x in np.split(rarity, np.cumsum([len(p) for p, _ in asked])[:-1])]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "told": pa.array(told, pa.binary())})


def least_overlap(a, b, percent: int):
    """What two sets of these sizes must share at least."""
    return -(-percent * (a + b) // (100 + percent))


def _members(state: pa.Table, told: pa.Table, n: int, percent: int) -> pa.Table:
    """The distinct sets of a block that can have a similar one, with what the filters need.

    A set is dropped if more of its n-grams are found in no other text than a similar set can lack.
    """
    ids = state.column("doc").combine_chunks().flatten().to_pylist()
    row, gram = gram_sets(pa.ipc.open_stream(state.column("data")[0].as_buffer()).read_all().column(0), n)
    size, h1, _ = _sums(row, gram, len(ids))
    wanted = {(x["doc"], x["h1"]) for x in (told.column("reps").combine_chunks().flatten().to_pylist())}
    _, back, _ = _counted(gram)
    answers = told.filter(pa.compute.is_valid(told.column("told"))).sort_by("bucket").column("told")
    rarity = np.concatenate([np.zeros(0, np.uint8), *(unpack(x, [np.uint8])[0] for x in answers)])[back]
    order = np.lexsort((gram, rarity, row))
    at, place = np.append(0, np.cumsum(size)), np.arange(len(row))
    place -= np.repeat(at[:-1], size)
    out: dict[str, list] = {c: [] for c in ("doc", "n", "alone", "prefix", "at", "parts", "grams")}
    for r in range(len(ids)):
        if (ids[r], int(h1[r])) not in wanted:
            continue
        wanted.discard((ids[r], int(h1[r])))
        total, own = int(size[r]), order[at[r] : at[r + 1]]
        shared = rarity[own] > 1
        alone, low = total - int(shared.sum()), -(-percent * total // 100)
        head = np.flatnonzero(shared[: total - low + 1])
        if total - alone < low or not len(head):
            continue
        grams = np.sort(gram[own[shared]])
        for c, x in zip(out, (ids[r], total, alone, gram[own[head]].view(np.int64), head, np.bincount((mix(grams) >> np.uint64(59)).astype(np.int64), minlength=PARTS).astype(np.int32).tobytes(), grams.tobytes()), strict=True):
            out[c].append(x)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    return pa.table({c: pa.array(x, k) for (c, x), k in zip(out.items(), kinds, strict=True)})


MEMBERS = "doc long, n long, alone long, prefix array<long>, at array<int>, parts binary, grams binary"


def _fits(na: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filter: what comes before and after a shared n-gram may be shared too, but no more."""
    most = np.minimum(i, j) + 1 + np.minimum(na - i - 1, nb - j - 1)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (most >= least_overlap(na, nb, percent))


def _parts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, PARTS)


def _pair_filter(percent: int):
    """Suffix filter: of each part of the two sets no more is shared than the smaller one has."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                most = np.minimum(_parts(batch.column("pa")), _parts(batch.column("pb"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(most >= least_overlap(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)))

    return kept


def _verify(percent: int):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, keep = batch.column("na").to_numpy(), batch.column("nb").to_numpy(), np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("ga"), batch.column("gb"), strict=True)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(two, one)
                keep[k] = (two[np.minimum(at, len(two) - 1)] == one).sum() >= least_overlap(na[k], nb[k], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return verified


def _meeting(rows: pa.Table, percent: int) -> np.ndarray:
    """The pairs of different classes in one tile, or in two, that pass all filters, each at its first shared n-gram."""
    doc, label, n, at, tile = (rows.column(c).to_numpy() for c in ("doc", "label", "n", "at", "tile"))
    gram, across = rows.column("gram")[0].as_py(), rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
    parts, prefix, found = _parts(rows.column("parts").combine_chunks()), [x.values.to_numpy() for x in rows.column("prefix")], []
    step = max(1, (1 << 20) // len(doc))
    for top in range(0, len(doc), step):
        i = np.arange(top, min(len(doc), top + step))[:, None]
        j = np.arange(len(doc))[None]
        maybe = (i < j) & (label[i] != label[j]) & _fits(n[i], n[j], at[i], at[j], percent)
        if across:
            maybe &= tile[i] != tile[j]
        x, y = np.nonzero(maybe)
        x += top
        for k in range(0, len(x), 1 << 16):
            p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            good = np.minimum(parts[p], parts[q]).sum(1) >= least_overlap(n[p], n[q], percent)
            for u, v in zip(p[good].tolist(), q[good].tolist(), strict=True):
                if prefix[u][np.isin(prefix[u], prefix[v]).argmax()] == gram:
                    found.append((min(doc[u], doc[v]), max(doc[u], doc[v])))
    return np.array(found, np.int64).reshape(-1, 2)


def _compared(percent: int):
    """Rows sorted by bucket and tiles: the pairs of each group, which may go on over batches."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: pa.Table) -> pa.RecordBatch:
            found = _meeting(group, percent)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [rows.column(c).to_numpy() for c in ("gram", "low", "high")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if len(rows) else []
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield pairs(rows.slice(a, b - a).combine_chunks())
            held = rows.slice(cuts[-1]) if len(cuts) else rows
        if held is not None and len(held):
            yield pairs(held.combine_chunks())

    return compared


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = 90, block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """`(id, n_shingles, component_id)`, one row for each row of `docs`.

    Two texts are linked when their sets of `n`-word shingles overlap by at least `percent` % of their union, and
    `component_id` is the smallest id that links reach. A text with fewer words is one shingle; null, empty and
    blank texts have none and are linked with nothing. Ids are whole numbers and should be distinct: rows that
    share an id get the smallest class any of them has, rows with a null id stay alone with a null class. Other columns
    are not carried. Empty in, empty out.

    Equal sets are merged first; only the one with the smallest id is joined. Of each n-gram in its prefix a set
    first meets one centre, the set with the fewest n-grams of its own, which keeps pairs linear in the rows and joins
    most of what belongs together; a second round takes a centre of another class. Where several classes are left
    under an n-gram, all pairs of different classes are looked at inside the tasks, and those that pass the length,
    positional and suffix filters are verified, so that no link is lost. No pair is verified twice.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be whole numbers, not {kind.simpleString()}")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // block_bytes))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts of a partition in blocks, with their compressed text and what they ask of each bucket."""
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False) + ROW_BYTES
            ends, first = np.cumsum(lengths), 0
            while first < len(batch):
                done = int(ends[first - 1]) if first else 0
                last = min(len(batch), max(first + 1, int(np.searchsorted(ends, done + block_bytes - size, "right"))))
                held.append(batch.slice(first, last - first))
                size, first = size + int(ends[last - 1]) - done, last
                if size >= block_bytes or first < len(batch):
                    yield block_of(number, pa.Table.from_batches(held))
                    held, size, number = [], 0, number + 1
        if held:
            yield block_of(number, pa.Table.from_batches(held))

    def block_of(number: int, rows: pa.Table) -> pa.RecordBatch:
        row, gram = gram_sets(rows.column("text"), n)
        total, h1, h2 = _sums(row, gram, rows.num_rows)
        prints, _, count = _counted(gram)
        own, cuts = np.unique((prints >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
        asks = [{"bucket": int(b), "data": pack([np.diff(p, prepend=np.uint64(0)), c], (np.uint64, np.int32))} for b, p, c in zip(own, np.split(prints, cuts[1:]), np.split(count, cuts[1:]), strict=True)] if len(own) else []
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([rows.schema.field("text")]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.select(["text"]))
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (rows.column("doc").to_pylist(), total, h1, h2)]
        return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([asks], pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())])))], names=["block", "doc", "n", "h1", "h2", "data", "asks"])

    dealt = materialise(base.mapInArrow(blocks, "block long, doc array<long>, n array<long>, h1 array<long>, h2 array<long>, data binary, asks array<struct<bucket int, data binary>>"), "join-blocks", rows_check=4)
    sigs = materialise(dealt.select("block", F.inline(F.arrays_zip("doc", "n", "h1", "h2"))), "join-signatures")
    known = sigs.where("doc is not null and n > 0")
    equal = materialise(known.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc", "block")).alias("rep"), F.count(F.lit(1)).alias("copies")).select("h1", "h2", "n", "rep.doc", "rep.block", "copies"), "join-equal")

    by = lambda df, key: df.repartition(buckets, key).groupBy(key)
    answers = by(dealt.select("block", F.inline("asks")), "bucket").applyInArrow(lambda key, rows: _count(rows), "block long, bucket int, told binary")
    reps = equal.groupBy("block").agg(F.collect_list(F.struct("doc", "h1")).alias("reps"))
    told = materialise(answers.unionByName(reps, allowMissingColumns=True), "join-answers", rows_check=4)
    found = by(dealt.select("block", "doc", "data"), "block").cogroup(by(told, "block")).applyInArrow(lambda state, told: _members(state, told, n, percent), MEMBERS)
    members = materialise(found, "join-members", rows_check=20)
    discard(dealt)
    discard(told)

    heads = members.withColumnRenamed("prefix", "gram").select("doc", "n", "alone", F.inline(F.arrays_zip("gram", "at")))
    crowd = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = materialise(heads.join(crowd, "gram").drop("size"), "join-heads")
    tested = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("label"))
    for turn in range(3):
        state = crowded.join(labels, crowded.doc == labels.node, "left").select("gram", "doc", "n", "at", "alone", F.coalesce("label", "doc").alias("label"))
        pairs = _to_centres(state, turn > 0, percent) if turn < 2 else _between_classes(state, members, percent, tile)
        pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "join-pairs")
        tested = tested.union(pairs)
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(_linked(members, pairs, percent)))

    copied = equal.where("copies > 1").join(labels, equal.doc == labels.node, "left").select("h1", "h2", "n", F.coalesce("label", "doc").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = sigs.select("doc", "n", "h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")).join(copied, ["h1", "h2", "n", "salt"], "left").join(labels, F.col("doc") == labels.node, "left")
    one = F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.coalesce("own", "label", "doc")).otherwise(F.col("doc"))
    apart = F.when(F.col("doc").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024)))  # rows without an id share nothing
    out = out.select("doc", "n", one.alias("one"), apart.alias("apart"))
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.min("one").over(W.partitionBy("doc", "apart")).cast(kind).alias("component_id"))


def _to_centres(state: DataFrame, other: bool, percent: int) -> DataFrame:
    """Candidate pairs of each set with the centre of each of its n-grams, if their classes differ.

    The centre is the set with the fewest n-grams of its own, with `other` the one of the class with the largest id.
    """
    own = F.struct((-F.col("alone")).alias("less"), (-F.col("doc")).alias("low"), "doc", "n", "at", "label")
    best = F.max(F.struct("label", own.alias("own"))).getField("own") if other else F.max(own)
    centre = state.groupBy("gram").agg(best.alias("c"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("gram", "c")
    met = state.join(centre, "gram").where(F.col("label") != F.col("c.label")).select(F.col("doc").alias("x"), F.col("c.doc").alias("y"), F.col("n").alias("nx"), F.col("c.n").alias("ny"), F.col("at").alias("i"), F.col("c.at").alias("j"))
    most = F.least("i", "j") + 1 + F.least(F.col("nx") - F.col("i") - 1, F.col("ny") - F.col("j") - 1)
    fit = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((100 + percent) * most >= percent * (F.col("nx") + F.col("ny")))
    return met.where(fit).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _between_classes(state: DataFrame, members: DataFrame, percent: int, tile: int) -> DataFrame:
    """Candidate pairs of different classes under one n-gram, without the sets. A large bucket is dealt into tiles, and
    every two of them meet in one comparison."""
    tiles = F.ceil(F.count(F.lit(1)) / tile).cast("int")
    mixed = state.groupBy("gram").agg(F.min("label").alias("least"), F.max("label").alias("most"), tiles.alias("tiles")).where("least < most").select("gram", "tiles")
    rows = state.join(mixed, "gram").withColumn("tile", F.pmod(F.xxhash64("doc"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("gram", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "doc", "n", "at", "label")
    rows = rows.join(members.select("doc", "prefix", "parts"), "doc").repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high")
    return rows.mapInArrow(_compared(percent), "a long, b long").distinct()


def _linked(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets overlap enough: sizes of parts first, then the sets, once for each pair."""
    side = lambda end, *more: members.select(F.col("doc").alias(end), F.col("n").alias(f"n{end}"), *[F.col(c).alias(f"{c[0]}{end}") for c in more])
    near = materialise(pairs.join(side("a", "parts"), "a").join(side("b", "parts"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_pair_filter(percent), "a long, b long"), "join-near")
    whole = near.join(side("a", "grams"), "a").join(side("b", "grams"), "b").select("a", "b", "na", "nb", "ga", "gb")
    return materialise(whole.mapInArrow(_verify(percent), "a long, b long"), "join-links")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_texts(docs)
