"""What the operators of this subpackage have in common.

* shared-folder tables that cut lineage and survive the loss of executors,
* connected components over an edge table,
* vectorised UTF-8 word scanning for Arrow batches.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the letters that lower-casing changes.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: `spark.checkpoint.dir` of the session.

    Where it is unset, a local master gets a temporary folder; any other master is an error, as no folder is known
    that all its machines share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if not hasattr(context, "_tracetide_folder"):
        local = context.master.startswith("local[") or context.master == "local"
        if not local:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context._tracetide_folder = tempfile.mkdtemp(prefix="tracetide-")
    return context._tracetide_folder


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; Hadoop removes it when the driver ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Bytes of one Arrow batch; Spark's default of 64 MB multiplies in the workers' arrays.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Shuffle files of a finished statement are removed at once instead of at the driver's next collection.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, partition_by: list[str] | None = None, rows_check: int = 100) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that later steps start from there.

    A row group is measured for the first time after `rows_check` rows: few for rows of megabytes, as readers
    hold a row group at once.
    """
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, tag), df.schema
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        rows = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": rows_check} if rows_check < 100 else {}
        df.write.options(**rows).parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    if partition_by:
        schema = type(schema)([f for f in schema if f.name not in partition_by] + [schema[c] for c in partition_by])
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that `materialise` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, label)` for every node of an edge; the label is the smallest node that can be reached.

    Alternating stars: every node hands its larger neighbours to the smallest node it knows, then each node and
    its smaller neighbours do the same, until only stars are left. Chains halve each round, so rounds grow
    with the logarithm of their length. Edges are a table in the shared folder; a count and a checksum come to
    the driver. Minima are combined before the shuffle; the joins have one row a node on one side, so a hub
    can be split by adaptive skew joins. Null ends and loops are ignored; no edges, no rows.
    """
    ends = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    state = materialise(ends.where("x and y and high <> low").select("high", "low").distinct(), "cc-edges")
    mark, sign = None, (F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low")))
    while True:
        both = state.select(F.col("low").alias("node"), F.col("low").alias("near")).union(state.select("high", "low"))
        near = both.groupBy("node").agg(F.min("near").alias("least"))
        large = state.join(near, state.low == near.node).select("high", F.col("least").alias("low")).distinct()
        own = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        moved = large.join(own, large.high == own.node).select(F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("least").alias("low"))
        after = materialise(moved.distinct(), "cc-edges")
        discard(state)
        state, before, mark = after, mark, tuple(after.agg(*sign).first())
        if mark == before or not mark[0]:
            return state.select(F.col("high").alias("node"), F.col("low").alias("label")).union(state.select(F.col("low").alias("node"), F.col("low").alias("label")).distinct())


# --- words of UTF-8 bytes -----------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
NGRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base & (2**64 - 1), np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole rows of about `limit` bytes (one row at least).

    Yields (first row, offsets from 0, bytes). Null is the empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """P with P[i] the hash sum of the first i bytes; a substring's hash is `(P[e] - P[s]) * inverse[s]`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of each maximal run of non-space bytes; A-Z hash as a-z."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= solid[cuts]
    last[cuts - 1] |= solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = prefix_hash(data, _LOWERED)
    value = mix((total[end] - total[start]) * powers(len(data))[1][start])
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, value


def ngrams(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words within a row."""
    if len(row) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(row) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += value[k : k + m] * NGRAM[k]
    index = np.flatnonzero(row[:m] == row[n - 1 :])
    return index, mix(total[index])
