"""SentencePiece encoding by streaming Viterbi over a piece table, and decoding.

The table's scores are taken as log-probabilities of pieces: the encoding is the segmentation with the
highest sum of scores, ties going to the earlier start of the last piece. (A table made by merges has ranks
as scores, so the fewest pieces win; this is not the order of merges.)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import bound_batches, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The sign for a space, the kinds of pieces in a model file, the penalty of an unknown character.
SPACE = 0x2581
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
PENALTY = 10.0
#: Characters after which a row goes on in a lane of its own, at the next boundary that no piece crosses.
PORTION = 512
#: Bytes of text encoded at a time.
SLICE = 1 << 18
_CODES = 0x110000


class Trie:
    """All pieces by their characters: for every start in a text, the pieces that begin there.

    The first character is looked up in a table of all characters, a further one by (node, character) in a
    hash table with linear probing.
    """

    def __init__(self, texts: list[str]):
        nodes: dict[str, int] = {}
        for text in texts:
            for k in range(1, len(text) + 1):
                nodes.setdefault(text[:k], len(nodes))
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[[nodes[t] for t in texts]] = np.arange(len(texts))
        self.root = np.full(_CODES, -1, np.int32)
        deeper = [(nodes[t[:-1]] * _CODES + ord(t[-1]), n) for t, n in nodes.items() if len(t) > 1]
        for t, n in nodes.items():
            if len(t) == 1:
                self.root[ord(t)] = n
        self.bits = max(4, (8 * len(deeper)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, node = (np.array(x, np.int64) for x in zip(*deeper, strict=True)) if deeper else (np.zeros(0, np.int64),) * 2
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.nodes[slot[free]] = key[free], node[free]  # of several for one slot the last stays
            left = self.keys[slot] != key
            key, node, slot = key[left], node[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after one more character, -1 where no piece goes on like this."""
        key = node.astype(np.int64) * _CODES + code
        slot = self._slot(key)
        met = self.keys[slot]
        out = np.where(met == key, self.nodes[slot], -1)
        open_ = np.flatnonzero((met != key) & (met >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[open_]]
            hit = met == key[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out


class Pieces:
    """The piece table of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if not spec.escape_whitespaces:
            raise ValueError("only models that write spaces as U+2581 are read")
        #: The library's normaliser where the model asks for more than a leading space; else None.
        self.normaliser = None
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            import sentencepiece

            self.normaliser = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.leading = spec.add_dummy_prefix
        own = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)]
        self.by_text = {t: (s, i) for t, s, i in own}
        self.longest = max(len(t) for t, _, _ in own)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.worst = min(s for _, s, _ in own) - PENALTY
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes = np.array([byte[b] for b in range(256)], np.int64) if len(byte) == 256 else None
        signs = {i: bytes([b]) for b, i in byte.items()}
        self.decoded = pa.array([signs.get(i, p.piece.replace(chr(SPACE), " ").encode() if p.type in (NORMAL, USER) else b"" if p.type != UNKNOWN else " ⁇ ".encode()) for i, p in enumerate(proto.pieces)], pa.binary())
        #: Scores and ids by a piece's place; the last two places are an unknown character and no piece.
        self.trie = Trie([t for t, _, _ in own])
        self.scores = np.array([s for _, s, _ in own] + [self.worst, -np.inf])
        self.ids = np.array([i for _, _, i in own] + [-1, -1])


class StreamingViterbi:
    """Encodes one stream of characters, given in any portions.

    Scores are kept for as many boundaries as the longest piece has characters. Pointers are kept back to the
    last boundary on every surviving path; when all paths through the window meet at a later boundary, the
    ids up to it are final and are handed out. Ids are piece ids, or -1 - code for an unknown character.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.window, self.scores, self.back, self.base = pieces, "", [0.0], {}, 0

    def feed(self, text: str) -> list[int]:
        """Takes characters; returns the ids that became final."""
        out, longest, table = [], self.pieces.longest, self.pieces.by_text
        for char in text:
            self.window = (self.window + char)[-longest:]
            end = self.base + len(self.back) + 1
            best = (-np.inf, 0, 0)
            for size in range(min(len(self.window), longest), 0, -1):
                before = self.scores[-size] if size <= len(self.scores) else -np.inf
                found = table.get(self.window[-size:])
                if found is None and size == 1:
                    found = self.pieces.worst, -1 - ord(char)
                if found and before + found[0] > best[0]:
                    best = before + found[0], end - size, found[1]
            self.scores = (self.scores + [best[0]])[-longest:]
            self.back[end] = best[1:]
            if len(self.back) % longest == 0:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Ids up to the boundary that all paths from the window share."""
        end = self.base + len(self.back)
        alive = set(range(max(self.base, end - self.pieces.longest + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last][0])
        return self._commit(alive.pop())

    def _commit(self, boundary: int) -> list[int]:
        out, at = [], boundary
        while at > self.base:
            at, piece = self.back[at]
            out.append(piece)
        for k in range(self.base + 1, boundary + 1):
            del self.back[k]
        self.base = boundary
        return out[::-1]

    def finish(self) -> list[int]:
        """The ids of what is left; the stream ends here."""
        return self._commit(self.base + len(self.back))


def lattice(codes: np.ndarray, limit: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(pieces by the place of their last character and by length, boundaries that no piece crosses).

    Column k holds pieces of `longest - k` characters. `limit` is the end of each character's row; the boundary
    before a character is marked if every piece that begins earlier ends by then.
    """
    n, longest, trie = len(codes), pieces.longest, pieces.trie
    unknown, none = len(pieces.ids) - 2, len(pieces.ids) - 1
    found = np.full((n, longest), none, np.int32)
    node = trie.root[codes]
    first = trie.piece[node]
    found[:, -1] = np.where((node >= 0) & (first >= 0), first, unknown)
    reach = np.arange(1, n + 1)
    start = np.flatnonzero(node >= 0)
    node = node[start]
    for size in range(2, longest + 1):
        inside = start + size <= limit[start]
        start, node = start[inside], node[inside]
        node = trie.next(node, codes[start + size - 1])
        start, node = start[node >= 0], node[node >= 0]
        if not len(start):
            break
        piece = trie.piece[node]
        own = piece >= 0
        found[start[own] + size - 1, longest - size] = piece[own]
        reach[start[own]] = start[own] + size
    free = np.ones(n, bool)
    free[1:] = np.maximum.accumulate(reach)[:-1] <= np.arange(1, n)
    return found, free


def streams(found: np.ndarray, start: np.ndarray, size: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last characters of the chosen pieces, their lengths) of many streams, advanced together.

    The window of a stream is the scores of its last `longest` boundaries. After each portion every path that
    can still win is followed back to the boundary on which all converge; pieces up to it are final, and
    are never looked at again. The longer of two equally good last pieces wins.
    """
    longest = found.shape[1]
    portion = 4 * longest
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    window = np.full((len(start), longest + portion), -np.inf)
    window[:, longest - 1] = 0.0
    step, final, base = np.zeros(len(found), np.int64), np.zeros(len(found), bool), start.copy()
    done = 0
    while done < (size[0] if len(size) else 0):
        for u in range(portion):
            n = int(np.searchsorted(-size, -(done + u), "left"))  # streams with a character left
            if not n:
                break
            at = start[:n] + (done + u)
            value = scores[found[at]] + window[:n, u : u + longest]
            best = value.argmax(1)
            window[:n, u + longest] = value[np.arange(n), best]
            step[at] = longest - best
        n = int(np.searchsorted(-size, -done, "left"))
        end = start[:n] + np.minimum(size[:n], done + portion)
        over = size[:n] <= done + portion
        alive = np.maximum(end[:, None] - np.arange(longest), base[:n, None])
        alive[over] = end[over, None]
        while True:
            ahead = alive > alive.min(1)[:, None]
            if not ahead.any():
                break
            alive[ahead] -= step[alive[ahead] - 1]
        meet, back = alive[:, 0], alive[:, 0].copy()
        while True:
            on = np.flatnonzero(back > base[:n])
            if not len(on):
                break
            final[back[on] - 1] = True
            back[on] -= step[back[on] - 1]
        base[:n] = meet
        window[:, :longest] = window[:, portion:].copy()
        done += portion
    last = np.flatnonzero(final)
    return last, step[last]


class Encoder:
    """Encodes columns of texts."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids per row) of rows of UTF-8 bytes.

        Every row begins with a space sign unless it is empty. A long row goes on in further streams at
        boundaries that no piece crosses, where all paths meet.
        """
        rows, codes, first = self._codes(offsets, data)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(first[1:], len(codes))
        own = np.repeat(np.arange(len(first)), ends - first)
        found, free = lattice(codes, ends[own], self.pieces)
        free[first] = True
        cut = np.flatnonzero(free)
        group = own[cut] * (int((ends - first).max()) // PORTION + 1) + (cut - first[own[cut]]) // PORTION
        cut = cut[np.append(True, group[1:] != group[:-1])]
        last, size = streams(found, cut, np.diff(np.append(cut, len(codes))), self.pieces.scores)
        piece = found[last, self.pieces.longest - size]
        ids = np.where(piece == len(self.pieces.ids) - 2, -1 - codes[last].astype(np.int64), self.pieces.ids[piece])
        per_row = np.zeros(len(offsets) - 1, np.int64)
        per_row[rows] = np.bincount(own[last], minlength=len(first))
        return self._bytes(ids, per_row)

    def _codes(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows that aren't empty, their characters one after the other, where each row begins)."""
        if self.pieces.normaliser:
            raw = data.tobytes()
            plain = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts = [self.pieces.normaliser.normalize(t) for t in plain]
            size = np.array([len(t) for t in texts], np.int64)
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            rows = np.flatnonzero(size)
            return rows, codes, np.append(0, np.cumsum(size[rows]))[:-1]
        place = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        codes[codes == 32] = SPACE
        rows = np.flatnonzero(np.diff(place) > 0)
        return rows, np.insert(codes, place[rows], SPACE), place[rows] + np.arange(len(rows))

    def _bytes(self, ids: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the pieces of their bytes, or the unknown piece without such."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, per_row
        if self.pieces.bytes is None:  # a run of unknown characters is one unknown piece
            row = np.repeat(np.arange(len(per_row)), per_row)
            more = odd[1:][(np.diff(odd) == 1) & (row[odd[1:]] == row[odd[:-1]])]
            ids = np.where(ids < 0, self.pieces.unknown, ids)
            return np.delete(ids, more), per_row - np.bincount(row[more], minlength=len(per_row))
        code, which = np.unique(-1 - ids[odd], return_inverse=True)
        spelt = [self.pieces.bytes[np.frombuffer(chr(c).encode(), np.uint8)] for c in code.tolist()]
        width = np.ones(len(ids), np.int64)
        width[odd] = np.array([len(s) for s in spelt])[which]
        ends = np.cumsum(width)
        out = np.repeat(ids, width)
        for k in range(4):
            more = np.array([s[k] if k < len(s) else 0 for s in spelt])[which]
            own = width[odd] > k
            out[(ends - width)[odd[own]] + k] = more[own]
        row = np.repeat(np.arange(len(per_row)), per_row)
        return out, np.bincount(row, width, len(per_row)).astype(np.int64)


def decode(ids: np.ndarray, per_row: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of rows) of rows of ids, the leading space of each row taken off."""
    spelt = pieces.decoded.take(pa.array(ids))
    buffers = spelt.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[: len(ids) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[: ends[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = ends[np.append(0, np.cumsum(per_row))]
    full = offsets[:-1][(np.diff(offsets) > 0)] if pieces.leading else offsets[:0]
    extra = full[data[full] == 32]
    keep = np.ones(len(data), bool)
    keep[extra] = False
    return data[keep], offsets - np.searchsorted(extra, offsets)


@lru_cache(maxsize=4)
def _loaded(model: bytes) -> Pieces:
    return Pieces(model)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """`(id, ids array<int>, n_ids, round_trip)`: the pieces of each text, and whether decoding gives it back.

    The model file is read on the driver and sent along. Null and empty texts have no ids and come back as the
    empty text. A text with the sign U+2581 doesn't come back, as it decodes to a space. Repeated rows
    are encoded alike, ids may be null, other columns are not carried. No shuffle; a task holds one batch of
    texts, and of these the lattice of some 256 KB or of one text. A model with a normaliser goes through the
    library's own, and its texts may come back normalised.
    """
    bound_batches(docs.sparkSession)
    with open(model, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_loaded(sent.value))
        for batch in batches:
            for base, offsets, data in text_slices(batch.column(1), SLICE):
                ids, count = encoder.encode(offsets, data)
                back, ends = decode(ids, count, encoder.pieces)
                if len(back) == len(data) and (back == data).all() and (ends == offsets).all():
                    same = np.ones(len(count), bool)
                else:
                    same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(count)), lists, pa.array(count), pa.array(same)], names=["id", "ids", "n_ids", "round_trip"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(encode, f"id {kind}, ids array<int>, n_ids long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """`(id, text)` from rows of ids; a null list is the empty text, broken UTF-8 gets replacement characters.

    An id that the model doesn't have is an error.
    """
    bound_batches(encoded.sparkSession)
    with open(model, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())
    kind = encoded.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(sent.value)
        for batch in batches:
            lists = batch.column(1)
            count = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            data, offsets = decode(lists.flatten().to_numpy().astype(np.int64), count, pieces)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())], names=["id", "text"])

    return encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(read, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
