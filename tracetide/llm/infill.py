"""Fill-in-middle: texts kept as seekable compressed frames, rearranged frame by frame.

A stored text is a row of independent zstandard frames with running counts of units and characters, so that the
frame of any unit is found by bisection. A transformed text is again a row of frames: those between two cuts are
taken over as they are, and only a frame with a cut is opened, divided and compressed anew. Any zstandard reader
can decompress the joined frames.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import bound_batches, text_slices

#: Bytes of text in a frame.
FRAME = 1 << 16
LEVEL = 1
#: What stands before each part in the output.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
STORE = "marked boolean, blob binary, ends array<long>, units array<long>, chars array<long>, joins array<boolean>"


def _unit_starts(frame: np.ndarray, joins: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where characters start; a frame that `joins` begins within a run of letters."""
    letter, char = _LETTER[frame], frame & 0xC0 != 0x80
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    if len(inner):
        inner[0] &= joins
    return char & ~inner, char


def frame_text(raw: np.ndarray, frame_bytes: int, pack: zstandard.ZstdCompressor) -> tuple[bytes, list[int], list[int], list[int], list[bool]]:
    """(frames, their ends, units and characters up to each end, whether each begins within a unit)."""
    blob, ends, units, chars, joins, at = [], [], [], [], [], 0
    while at < len(raw):
        end = min(len(raw), at + frame_bytes)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        frame, join = raw[at:end], bool(at and _LETTER[raw[at - 1]])
        blob.append(pack.compress(frame.tobytes()))
        unit, char = _unit_starts(frame, join)
        for total, own in ((ends, len(blob[-1])), (units, int(unit.sum())), (chars, int(char.sum()))):
            total.append((total[-1] if total else 0) + own)
        joins.append(join)
        at = end
    return b"".join(blob), ends, units, chars, joins


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME) -> DataFrame:
    """`(id, marked, blob, ends, units, chars, joins)`: each text as independent frames of about `frame_bytes` bytes.

    Units are runs of ASCII letters and single other characters. `ends`, `units` and `chars` are the running
    totals of compressed bytes, units and characters at the end of each frame; `marked` says whether the text holds
    one of the marks. A unit longer than a frame goes on in the next (`joins`). Null and empty texts have no
    frames. One row for each row of `docs`, null and repeated ids too; other columns are not carried.
    """
    if frame_bytes < 4:
        raise ValueError("a frame must have room for a character")
    bound_batches(docs.sparkSession)
    kind, text = docs.schema[id_col].dataType.simpleString(), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.contains(text, F.lit(mark.decode()))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for _, offsets, data in text_slices(batch.column("text")):
                rows += [frame_text(data[a:b], frame_bytes, pack) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            blob, ends, units, chars, joins = zip(*rows, strict=True) if rows else ((),) * 5
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (ends, units, chars)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("marked"), pa.array(blob, pa.binary()), *longs, pa.array(joins, pa.list_(pa.bool_()))], names=["id", "marked", "blob", "ends", "units", "chars", "joins"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), marked.alias("marked")).mapInArrow(framed, f"id {kind}, {STORE}").withColumnRenamed("id", id_col)


class _Frames:
    """A stored text that is opened frame by frame."""

    def __init__(self, blob: bytes, ends: list[int], units: list[int], chars: list[int], joins: list[bool]):
        self.blob, self.ends, self.units, self.chars, self.joins = memoryview(blob), [0, *ends], [0, *units], [0, *chars], joins

    def raw(self, k: int) -> memoryview:
        return self.blob[self.ends[k] : self.ends[k + 1]]

    def cut(self, unit: int, unpack: zstandard.ZstdDecompressor) -> tuple[int, int, int]:
        """(frame, byte in it, characters before it) where a unit starts; the end of the text after the last unit."""
        if unit >= self.units[-1]:
            return len(self.ends) - 1, 0, self.chars[-1]
        k = bisect_right(self.units, unit) - 1  # the last of those with so many before: frames within one unit start none
        starts, char = _unit_starts(np.frombuffer(unpack.decompress(self.raw(k)), np.uint8), self.joins[k])
        at = int(np.flatnonzero(starts)[unit - self.units[k]])
        return k, at, self.chars[k] + int(char[:at].sum())

    def between(self, a: tuple[int, int, int], b: tuple[int, int, int], pack: zstandard.ZstdCompressor, unpack: zstandard.ZstdDecompressor) -> Iterator[bytes | memoryview]:
        """The frames from one cut to another; whole ones are handed on unopened."""
        (k, x, _), (m, y, _) = a, b
        for frame in range(k, m + (y > 0)):
            low, high = x if frame == k else 0, y if frame == m else None
            if low == 0 and high is None:
                yield self.raw(frame)
            elif part := unpack.decompress(self.raw(frame))[low:high]:
                yield pack.compress(part)


def _draws(seed: int, id_col: str) -> list:
    """Four numbers below 2**32 that rest on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(store: DataFrame, id_col: str = "doc_id", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """`(id, n, form, prefix_chars, middle_chars, frames, ends)` for each stored text; `frames` are the output's.

    Two numbers drawn by seed and id choose where prefix and middle end, among the n + 1 places between units.
    `rate` % of the texts are rearranged, of those `spm_rate` % as spm (suffix, prefix, middle) and the others as
    psm (prefix, suffix, middle), each part after its mark. Empty texts, the rest, and texts that hold a mark, which
    could not be told apart again, stay plain, with null counts. A null id draws as the empty string.
    """
    kind = store.schema[id_col].dataType.simpleString()
    known = store.select(F.col(f"`{id_col}`").alias("id"), "marked", "blob", "ends", "units", "chars", "joins", *_draws(seed, id_col))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        marks = {part: pack.compress(mark) for part, mark in MARKS.items()}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "frames", "ends")}
            for marked, blob, ends, units, chars, joins, h1, h2, h3, h4 in zip(*(batch.column(c).to_pylist() for c in batch.schema.names[1:]), strict=True):
                n, text, frames, sizes = (units[-1] if units else 0), _Frames(blob, ends, units, chars, joins), blob, ends
                form = "plain" if not n or marked or h3 % 100 >= rate else "spm" if h4 % 100 < spm_rate else "psm"
                counts = (None, None)
                if form != "plain":
                    cuts = [text.cut(u, unpack) for u in sorted((h1 % (n + 1), h2 % (n + 1)))]
                    places = {"prefix": ((0, 0, 0), cuts[0]), "middle": cuts, "suffix": (cuts[1], text.cut(n, unpack))}
                    pieces = [x for part in ORDER[form] for x in (marks[part], *text.between(*places[part], pack, unpack))]
                    frames, sizes = b"".join(pieces), np.cumsum([len(x) for x in pieces]).tolist()
                    counts = (cuts[0][2], cuts[1][2] - cuts[0][2])
                for c, x in zip(out, (n, form, *counts, frames, sizes), strict=True):
                    out[c].append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True))], names=["id", *out])

    return known.mapInArrow(filled, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, frames binary, ends array<long>").withColumnRenamed("id", id_col)


def _opened(frames: memoryview, ends: list[int], unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    for a, b in zip([0, *ends], ends, strict=False):
        yield unpack.decompress(frames[a:b])


def parts(form: str, chunks: Iterable[bytes]) -> Iterator[tuple[str, bytes]]:
    """(part, bytes) as an output has them, found by its marks, which may lie across two chunks."""
    ahead, part, held = [(MARKS[p], p) for p in ORDER.get(form, ())], None if form in ORDER else "text", b""
    for chunk in chunks:
        held += chunk
        while ahead and (at := held.find(ahead[0][0])) >= 0:
            if at:
                yield part, held[:at]
            held, part = held[at + len(ahead[0][0]) :], ahead.pop(0)[1]
        sure = max(0, len(held) - 2) if ahead else len(held)  # the last two bytes may begin a mark
        if sure:
            yield part, held[:sure]
        held = held[sure:]
    if held:
        yield part, held


def output_texts(filled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`(id, form, output)`: the transformed texts."""
    kind = filled.schema[id_col].dataType.simpleString()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [b"".join(_opened(x.as_buffer(), e, unpack)).decode() for x, e in zip(batch.column("frames"), batch.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("form"), pa.array(texts, pa.string())], names=["id", "form", "output"])

    return filled.select(F.col(f"`{id_col}`").alias("id"), "form", "frames", "ends").mapInArrow(opened, f"id {kind}, form string, output string").withColumnRenamed("id", id_col)


def digests(filled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`: digests of the output, and of the
    text put together again from output and form. Frames stream; the second digest reads them twice, as the suffix
    comes before the middle in the output and after it in the text."""
    kind = filled.schema[id_col].dataType.simpleString()
    same = ["n", "form", "prefix_chars", "middle_chars"]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            outputs, texts = [], []
            for form, frames, ends in zip(batch.column("form").to_pylist(), batch.column("frames"), batch.column("ends").to_pylist(), strict=True):
                whole, restored, view = hashlib.sha256(), hashlib.sha256(), memoryview(frames.as_buffer())
                for chunk in _opened(view, ends, unpack):
                    whole.update(chunk)
                for wanted in (("prefix", "middle"), ("suffix",)) if form in ORDER else (("text",),):
                    for part, chunk in parts(form, _opened(view, ends, unpack)):
                        if part in wanted:
                            restored.update(chunk)
                outputs.append(whole.hexdigest())
                texts.append(restored.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in same), pa.array(outputs, pa.string()), pa.array(texts, pa.string())], names=["id", *same, "output_sha256", "restored_sha256"])

    rows = filled.select(F.col(f"`{id_col}`").alias("id"), *same, "frames", "ends")
    return rows.mapInArrow(digested, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string").withColumnRenamed("id", id_col)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(fill_in_middle(store_frames(docs)))


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS d FROM documents),
numbered AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM drawn),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbered),
piece AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM piece)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN split_part(split_part(o, '<S>', 1), '<P>', 2) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<P>', 1), '<S>', 2) END) AS restored_sha256
FROM made
"""
