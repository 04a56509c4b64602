"""WARC archives: a deterministic sharded writer with manifests, and a reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import bound_batches, materialise, new_path

#: Payload bytes a shard is planned for, and compressed bytes at which a file of a shard is closed.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
#: Ids sampled by hash for the borders of shards, about; the sample doesn't depend on how the table is stored.
SAMPLE = 10_000
#: Fixed value: records need a date, and equal input must give equal files.
DATE = "2000-01-01T00:00:00Z"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, sha1: str, copy: int = 0) -> str:
    """A record's name: its page, its payload, and a number if a page holds the payload more than once."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{sha1}{f':{copy}' if copy else ''}>"


def _member(head: list[str], payload: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*head, f"Content-Length: {len(payload)}"]).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + pack.flush()


def file_info(name: str) -> bytes:
    """The record that opens a file."""
    return _member(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, size: int, sha1: str, copy: int = 0) -> bytes:
    """One gzip member that holds one WARC record."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, sha1, copy)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, sha1)}"]
    return _member([*head, "Content-Type: text/html; charset=utf-8"], payload)


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each gzip member of a file."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("truncated record")
                return
            parts.append(member.decompress(data))
        rest = member.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        if lines[0] != "WARC/1.1" or len(body) != size + 4:
            raise ValueError("broken record")
        yield fields, body[:size]


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`(page_id, sha1, refers)`: the largest id among equal payloads, for payloads of `min_bytes` or more.

    Only ids and digests are shuffled. A null id counts as smaller than any other.
    """
    ids = pages.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    first = ids.groupBy("sha1").agg(F.max("page_id").alias("refers"))
    return ids.where(F.col("size") >= min_bytes).select("page_id", "sha1").distinct().join(first, "sha1")


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes one record a row under `out` and returns the manifest `(shard, part, file, records, bytes, sha256)`.

    Rows are sorted by id over shards whose borders come from a sample taken by hash, so the same rows give
    the same files whatever the partitioning. A shard opens a new file when the last one reaches
    `roll_bytes` of compressed data. A task writes under names of its own attempt; the manifest holds only
    what the winning attempts wrote, and a second step, dealt by file, moves those files to their final names,
    which can be repeated; the manifest follows when all are in place. Each file opens with a `warcinfo` record. Files of lost attempts stay behind under temporary names and are never read.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the largest id becomes a response
    and the others revisit it; of equal rows the first does. Null payloads are empty, null urls leave the
    header out, null ids come first. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    plan = plan_records(rows, min_bytes)
    size, count = (x or 0 for x in rows.agg(F.sum(F.octet_length("payload").cast("long")), F.count(F.lit(1))).first())
    shards = max(1, -(-size // shard_bytes))
    drawn = F.pmod(F.xxhash64("page_id"), F.lit(max(1, count // SAMPLE))) == 0
    sample = rows.where(F.col("page_id").isNotNull() & drawn).select("page_id").toPandas()["page_id"].sort_values().to_numpy(np.int64)
    borders = np.unique(sample[[len(sample) * k // shards for k in range(1, shards)]]) if len(sample) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(borders, ids.fillna(0).to_numpy(np.int64), "right")).astype(np.int32))

    orders = plan.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "sha1", "refers")
    both = orders.unionByName(rows.withColumns({"sha1": F.sha1("payload"), "refers": F.lit(None).cast("long")}))
    dealt = both.withColumn("shard", shard_of("page_id")).repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("payload").isNotNull(), "sha1", F.col("url").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        store, base = _store(out)
        store.create_dir(f"{base}/tmp", recursive=True)
        attempt, shard, part, sink = uuid4().hex, -1, 0, None
        done, page, refers, answered = [], object(), {}, Counter()

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                done[-1][3:] = [count, written, sha.hexdigest()]
                sink = None

        for batch in batches:
            for page_id, url, payload, sha1, told, own in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers", "shard")), strict=True):
                page_id = page_id.as_py()
                if page_id != page:
                    page, refers, answered = page_id, {}, Counter()
                if not payload.is_valid:
                    refers[sha1.as_py()] = told.as_py()
                    continue
                raw, key = payload.as_buffer().to_pybytes(), sha1.as_py()
                to = refers.get(key, page)
                revisit = key in refers and (to != page or answered[key] > 0)
                copy = answered[key]
                answered[key] += 1
                if own.as_py() != shard:
                    close()
                    shard, part = own.as_py(), 0
                if sink is not None and written >= roll_bytes:
                    close()
                    part += 1
                if sink is None:
                    name = f"shard-{shard:06d}-{part:05d}.warc.gz"
                    done.append([shard, part, name, 0, 0, ""])
                    sink, count, written, sha = store.open_output_stream(f"{base}/tmp/{attempt}-{name}", compression=None), 0, 0, hashlib.sha256()
                    opening = file_info(name)
                    sink.write(opening)
                    sha.update(opening)
                    written = len(opening)
                member = record(page_id, url.as_py(), b"" if revisit else raw, to, revisit, len(raw), base64.b32encode(bytes.fromhex(key)).decode(), copy)
                sink.write(member)
                sha.update(member)
                count, written = count + 1, written + len(member)
        close()
        columns = list(zip(*done, strict=True)) if done else [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array([f"tmp/{attempt}-{x[2]}" for x in done], pa.string())], names=["shard", "part", "file", "records", "bytes", "sha256", "temporary"])

    written_files = materialise(dealt.mapInArrow(write, "shard int, part int, file string, records long, bytes long, sha256 string, temporary string"), "warc-written")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(out)
        for batch in batches:
            for name, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if store.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{base}/{temporary}", f"{base}/{name}")
                elif store.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield batch.drop_columns(["temporary"])

    dealt = written_files.repartition(spark.sparkContext.defaultParallelism * 4, "file")
    manifest = materialise(dealt.mapInArrow(move, "shard int, part int, file string, records long, bytes long, sha256 string"), "warc-moved")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{out}/manifest")


READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_warc(manifest: DataFrame, out: str, payload: bool = True) -> DataFrame:
    """The records of the files a manifest names, one row each; digests and lengths are checked.

    A file is read as a stream, so a task holds one record at a time. With `payload` false the payload is
    checked but not returned.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(out)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        urn = lambda x: None if x is None or x.startswith("<urn:x-page:null:") else int(x.split(":")[2])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, body in records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        kind, sha1, size = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
                        if kind == "response" and (digest(body) != sha1 or len(body) != size):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its header")
                        rows.append((urn(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, sha1, size, urn(fields.get("WARC-Refers-To")), body if payload and kind == "response" else None))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = manifest.select("file").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return files.mapInArrow(read, READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = new_path(spark, "warc")
    manifest = write_warc(pages, out)
    return read_warc(manifest, out, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
d AS (SELECT *, list_transform(range(41), lambda i: position(substr(x, CAST(i + 1 AS INT), 1) IN '0123456789abcdef') - 1) AS n FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((n[5 * i // 4 + 1] * 16 + n[5 * i // 4 + 2]) >> CAST(3 - 5 * i % 4 AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""
