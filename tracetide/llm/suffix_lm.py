"""A probabilistic suffix tree over words: trained on part of a corpus, scoring all of it.

The text is dealt into blocks of bounded size, which keep their words as small local numbers and send them as numbers of the
whole corpus, small ones for frequent words, so that strings are short where they move. The tree grows by
one word of context at a time: each block asks for the strings (a context and its next word) at its open
positions, whose contexts are frequent; requests are dealt by hash, counted over the training documents and
answered in the order in which they were asked. Neither the vocabulary nor the tree has to fit into one process.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import NGRAM, bound_batches, discard, materialise, mix, text_slices, words

BLOCK_BYTES = 4 << 20
#: The most words in a context; growth ends before where no context of that length is frequent.
DEPTH = 5
#: Occurrences a context needs to be tested, and a next word to be counted in one, at any size of the corpus.
MIN_CONTEXT, MIN_NEXT = 16, 4
#: Taken off each count, and nats by which a context must beat its suffix on the training text.
DISCOUNT, GAIN = 0.75, 10.0
#: The strings of contexts with this many occurrences or more are dealt over several buckets.
HOT = 1 << 16
#: Blocks that one row names as askers of a hot context.
BLOCKS_A_ROW = 1 << 12
#: A pass asks for about so many bytes of strings for each byte of text at most, at ASKED bytes an open position; the strings
#: of one word of context are made anew in each pass, so theirs are fewer, and more of their positions share one.
FIRST_SHARE, PASS_SHARE, FIRST_ASKED, ASKED = 0.6, 0.2, 5, 10
#: Blocks are kept in so many tables, so that old ones can go while new ones are made; what they are told lies by these parts too.
PARTS = 8
#: Buckets of strings, or of words, whose answers are one file of a part.
BUCKETS_A_TASK = 4
#: Fixed value: the token that ends a document.
END = np.uint64(0x9E3779B97F4A7C15)
#: The number of all next words that aren't counted, so that a block asks for their contexts too; other words' numbers are above.
RARE = np.uint64(0)
ASK = "block long, bucket int, data binary"
FOUND = "block long, bucket int, told binary, context long, gain double, share double, occurs long, blocks array<long>"
#: The numbers a block keeps beside those of its documents: its words (hashes, then their numbers) and, at first, their counts and its tokens;
#: its contexts and how often they occur; its open positions by the steps between them and their strings; and of
#: each string context, next word, chance without the context, and occurrences in training documents of the block.
KEPT = {"word": np.uint64, "count": np.int64, "token": np.int32, "context": np.uint64, "occurs": np.int64, "step": np.int32, "string": np.int32, "at": np.int32, "next": np.int32, "lower": np.float32, "trained": np.int32}
#: Strings that a bucket is asked about: contexts, how often they occur, their numbers of strings, and next words,
#: occurrences in the block and chances without the context.
ASKED_FOR = (np.uint64, np.int64, np.int32, np.uint64, np.int32, np.float32)
DOCS = {"held": "boolean", "n_tokens": "long", "n_known": "long", "base": "double", "total": "double"}
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(arrays: Iterable[np.ndarray], kinds: Iterable[type]) -> bytes:
    """Arrays of numbers as compressed bytes, all lowest bytes of an array first."""
    cast = [np.ascontiguousarray(a, k) for a, k in zip(arrays, kinds, strict=True)]
    raw = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in cast)
    return np.array([len(raw), *map(len, cast)], np.int64).tobytes() + _ZSTD.compress(raw, asbytes=True)


def unpack(data: pa.Scalar, kinds: Iterable[type]) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    buffer, head = data.as_buffer(), 8 * (len(kinds) + 1)
    size, *lengths = np.frombuffer(buffer[:head], np.int64).tolist()
    raw, out, at = np.frombuffer(_ZSTD.decompress(buffer[head:], size), np.uint8), [], 0
    for kind, n in zip(kinds, lengths, strict=True):
        own = raw[at : at + n * kind.itemsize]
        out.append(np.ascontiguousarray(own.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * NGRAM[20] + b * NGRAM[21])


def block_tokens(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token hash) of a column of texts, an END after the words of each row."""
    rows, tokens = [], []
    for base, offsets, data in text_slices(text):
        row, _, _, value = words(offsets, data)
        n = len(offsets) - 1
        out, own = np.full(len(row) + n, END, np.uint64), np.empty(len(row) + n, np.int64)
        at = np.arange(len(row)) + row
        out[at], own[at] = value, row
        own[np.cumsum(np.bincount(row, minlength=n)) + np.arange(n)] = np.arange(n)
        rows.append(own + base)
        tokens.append(out)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(tokens)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, an index of each, the place of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def _renumbered(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers, in order, and the place of each number among them) of numbers below `size`."""
    used = np.zeros(size, bool)
    used[numbers] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[numbers]


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each key by its high bits."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _state(block: int, ids: pa.Array, docs: dict[str, np.ndarray], kept: dict[str, np.ndarray]) -> pa.Table:
    """A block as a table of one row: lists over its documents, and what else it keeps."""
    lists = {c: pa.array([v]) for c, v in docs.items()}
    one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    kept = kept | {"at": np.diff(kept["at"], prepend=0)}  # strings lie by context, so steps are short
    return pa.table({"block": pa.array([block], pa.int64()), "id": one, **lists, "open": pa.array([max(len(kept["token"]), len(kept["at"]))], pa.int64()), "data": pa.array([pack([kept[c] for c in KEPT], KEPT.values())], pa.binary())})


def _kept(rows: pa.Table) -> dict[str, np.ndarray]:
    docs = {c: _flat(rows, c) for c in DOCS}
    kept = dict(zip(KEPT, unpack(rows.column("data")[0], KEPT.values()), strict=True))
    return docs | kept | {"at": np.cumsum(kept["at"], dtype=np.int32)}


def _with_strings(kept: dict[str, np.ndarray], place: np.ndarray, row: np.ndarray, at: np.ndarray, next_: np.ndarray, live: np.ndarray, chance: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of open positions, whose strings are the pairs of context and next word.

    Positions that aren't live, as their next words can't be counted any more, share the string (context, RARE):
    what their context leaves to its suffix still counts.
    """
    base = len(kept["word"]) + 1
    strings, first, back = _distinct(at * base + np.where(live, next_, base - 1))
    trained = np.bincount(back, live & ~kept["held"][row], len(strings))
    used, number = _renumbered(np.append(strings % base, base - 1), base)  # words that no string needs any more are dropped
    return {"word": kept["word"][used[:-1]], "step": np.diff(place, prepend=0), "string": back, "at": strings // base, "next": number[:-1], "lower": np.where(live, chance, 1.0)[first], "trained": trained}


def _first_level(kept: dict[str, np.ndarray], smallest: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(columns of the positions after one frequent word, logarithms that are final by document)."""
    token, docs = kept["token"].astype(np.int64), len(kept["n_tokens"])
    row = np.repeat(np.arange(docs), kept["n_tokens"])
    count = np.append(kept["count"], 0)
    chance = (count[token] + 1) * smallest
    follows = np.flatnonzero((row[1:] == row[:-1]) & (count[token[:-1]] >= MIN_CONTEXT)) + 1
    counted = token < len(kept["word"])
    final = counted.copy()  # what rare words score is final already
    final[follows] = False
    columns = _with_strings(kept, follows, row[follows], token[follows - 1], token[follows], counted[follows], chance[follows])
    return {**columns, "context": np.append(kept["word"], RARE), "occurs": count}, np.bincount(row[final], np.log10(chance[final]), docs)


class Dealt:
    """The strings of a block (of one pass) in the order in which they are dealt to buckets."""

    def __init__(self, kept: dict[str, np.ndarray], buckets: int, hot: int, passes: int = 1, part: int = 0):
        self.kept, self.word = kept, np.append(kept["word"], RARE)
        at = kept["at"]
        bucket, over = _bucket(mix(kept["context"]), buckets)[at], np.flatnonzero((kept["occurs"] >= hot)[at])
        salt = self.word[kept["next"][over]] % (kept["occurs"][at[over]] // hot + 1).astype(np.uint64)
        bucket[over] = _bucket(mix(kept["context"][at[over]] + salt * NGRAM[22]), buckets)
        chosen = np.flatnonzero(bucket % passes == part)
        bucket = bucket[chosen]
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # short numbers sort by digits
        self.order, self.bucket = chosen[order], bucket[order]
        self.at = kept["at"][self.order]
        new = np.ones(len(bucket), bool)
        new[1:] = (self.bucket[1:] != self.bucket[:-1]) | (self.at[1:] != self.at[:-1])
        #: Where the strings of each (bucket, context) begin in the order of dealing.
        self.entry = np.flatnonzero(new)

    def ask(self, block: int) -> pa.Table:
        """One row for each bucket of the pass: contexts, and their strings."""
        kept, order, entry = self.kept, self.order, self.entry
        size = np.diff(np.append(entry, len(order)))
        own, strings = np.unique(self.bucket, return_counts=True)
        entries = np.bincount(np.searchsorted(own, self.bucket[entry]), minlength=len(own))
        split = lambda cuts, x: np.split(x, np.cumsum(cuts)[:-1])
        columns = [*(split(entries, x) for x in (kept["context"][self.at[entry]], kept["occurs"][self.at[entry]], size)), *(split(strings, x) for x in (self.word[kept["next"][order]], kept["trained"][order], np.log(kept["lower"][order])))]
        return pa.table({"block": np.full(len(own), block, np.int64), "bucket": own, "data": pa.array([pack(x, ASKED_FOR) for x in zip(*columns, strict=True)] if len(own) else [], pa.binary())})

    def answers(self, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(count of each string, what each context leaves to its suffix if it is retained, else 0)."""
        told = told.sort_by("bucket")
        verdicts = pa.compute.less(told.column("bucket"), 0)
        hot, told = told.filter(verdicts), told.filter(pa.compute.invert(verdicts))
        lists = [unpack(x, (np.int64, np.int64)) for x in told.column("told")]
        n, rest = np.zeros(len(self.order), np.int64), np.zeros(len(self.kept["context"]))
        quarters = np.zeros(len(rest), np.int64)
        if lists:
            n[self.order] = np.concatenate([x for x, _ in lists])
            quarters[self.at[self.entry]] = np.concatenate([x for _, x in lists])
        kept = np.flatnonzero(quarters > 0)
        rest[kept] = 1 - quarters[kept] / 4 / self.kept["occurs"][kept]
        unsaid = np.flatnonzero(quarters < 0)
        if len(unsaid):
            known, first, _ = _distinct(_flat(hot, "contexts").view(np.uint64))
            rest[unsaid] = _flat(hot, "rests")[first][np.searchsorted(known, self.kept["context"][unsaid])]
        return n, rest


def _next_level(dealt: Dealt, told: pa.Table, last: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(columns of the positions whose longer context is frequent, logarithms that are final by document)."""
    kept = dealt.kept
    n, rest = dealt.answers(told)
    at, back, live = kept["at"], kept["string"].astype(np.int64), kept["next"] < len(kept["word"])
    share = np.where(live & (n >= 2), n - DISCOUNT, 0.0) / kept["occurs"][at]
    left = rest[at]
    chance = np.where(live & (left > 0), share + left * kept["lower"], kept["lower"])
    place = np.cumsum(kept["step"].astype(np.int64))
    row = np.searchsorted(np.cumsum(kept["n_tokens"]), place, "right")

    lift = np.full(len(back), -1, np.int64)
    here = np.flatnonzero((n >= MIN_CONTEXT)[back[:-1]]) if len(back) and not last else np.zeros(0, np.int64)
    here = here[(place[here + 1] == place[here] + 1) & (row[here + 1] == row[here])]
    lift[here + 1] = back[here]
    stay = lift >= 0
    ended = np.where(live, np.log10(chance), np.where(left > 0, np.log10(np.where(left > 0, left, 1.0)), 0.0))
    unseen = ended * (~live | (n < 2))  # what is final even where the position stays open
    final = np.bincount(row, np.where(stay, unseen[back], ended[back]), len(kept["n_tokens"]))

    contexts, own = _renumbered(lift[stay], len(n))
    own_string = back[stay]
    columns = _with_strings(kept, place[stay], row[stay], own, kept["next"][own_string].astype(np.int64), live[own_string] & (n[own_string] >= 2), chance[own_string])
    return {**columns, "context": _pair(kept["context"][at[contexts]], dealt.word[kept["next"][contexts]]), "occurs": n[contexts]}, final


def _judge(rows: pa.Table, last: bool, most: int) -> pa.Table:
    """Counts the strings of one bucket over all blocks: each row is answered in its own order.

    `n` is what a block needs of each string's count (0 if it needs none), `quarters` four times what a retained context gives
    to its next words, a whole number (0 if it isn't retained, -1 where other buckets have a say). Such hot contexts add rows with
    block -1: their part of the gain and of the share, and the blocks that asked, so many to a row.
    """
    asked = [unpack(x, ASKED_FOR) for x in rows.column("data")]
    entry_count, string_count = (np.array([len(x[k]) for x in asked], np.int64) for k in (0, 3))
    entries, occurs, size, word, trained, lower = (np.concatenate(x) for x in zip(*asked, strict=True))
    of_entry = np.repeat(np.arange(len(entries)), size)
    _, first, back = _distinct(_pair(entries[of_entry], word))
    n = np.bincount(back, trained, len(first)).astype(np.int64)
    contexts, one, of_context = _distinct(entries)
    occurs, at = occurs[one], of_context[of_entry[first]]
    seen = np.flatnonzero(n >= 2)
    k, own = n[seen], at[seen]
    gain = np.bincount(own, (k - 1) * (np.log((k - DISCOUNT) / occurs[own]) - lower[first[seen]]), len(contexts))
    share = np.bincount(own, k - DISCOUNT, len(contexts))
    hot = occurs >= most
    quarters = np.where(hot, -1, np.where(gain >= GAIN, np.rint(4 * share), 0)).astype(np.int64)  # DISCOUNT is three of them
    needed = (n >= 2) & ((quarters[at] != 0) | ((n >= MIN_CONTEXT) & (not last)))
    split = lambda cuts, x: np.split(x, np.cumsum(cuts)[:-1])
    told = [pack(x, (np.int64, np.int64)) for x in zip(split(string_count, np.where(needed, n, 0)[back]), split(entry_count, quarters[of_context]), strict=True)]
    asks = hot[of_context]
    which, from_block = of_context[asks], np.repeat(rows.column("block").to_numpy(), entry_count)[asks]
    order = np.lexsort((from_block, which))
    which, from_block = which[order], from_block[order]
    new = np.append(True, (which[1:] != which[:-1]) | (from_block[1:] != from_block[:-1]))[: len(which)]
    which, from_block = which[new], from_block[new]
    first = np.searchsorted(which, which)
    cuts = np.flatnonzero((np.arange(len(which)) - first) % BLOCKS_A_ROW == 0)
    once = first[cuts] == cuts  # only a context's first row adds to its sums
    which, blocks = which[cuts], np.split(from_block, cuts[1:]) if len(cuts) else []
    lines, more = len(told), len(which)
    blocks = [None] * lines + blocks
    none = lambda kind: pa.nulls(lines, kind)
    both = lambda kind, x: pa.concat_arrays([none(kind), pa.array(x, kind)])
    return pa.table({
        "block": np.append(rows.column("block").to_numpy(), np.full(more, -1)), "bucket": np.append(rows.column("bucket").to_numpy(), np.full(more, -1)).astype(np.int32),
        "told": pa.array(told + [None] * more, pa.binary()), "context": both(pa.int64(), contexts[which].view(np.int64)), "gain": both(pa.float64(), gain[which] * once), "share": both(pa.float64(), share[which] * once),
        "occurs": both(pa.int64(), occurs[which]), "blocks": pa.array(blocks, pa.list_(pa.int64())),
    })


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """`(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`, one row for each row of `docs`.

    Tokens are runs of non-space bytes with A-Z lower-cased, told apart by 64-bit hashes, and one end for each
    document. Statistics come from the rows where `held_out` is not true. The base score adds up
    log10((c + 1) / (N + V + 1)). The tree's root is that distribution; a context of up to `depth` words is
    tested if it occurs MIN_CONTEXT times, and retained if its next words are likelier under it than
    under its suffix by GAIN nats in all, leaving out each word's first occurrence. A retained context gives
    a word seen twice or more its discounted share, and the rest to its suffix's distribution. Each
    token is scored at the longest retained suffix of the words before it in its document.

    Null and empty texts have one token, their end. Null ids are kept; a null `held_out` means training. Equal
    rows count twice and are scored alike. Other columns are not carried. Empty in, empty out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size, given = base.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1))).first()
    size = size or 0
    blocks = max(1, -(-size // block_bytes))
    schema = f"block long, id array<{kind}>, " + ", ".join(f"{c} array<{t}>" for c, t in DOCS.items()) + ", open long, data binary"
    totals = {"N": 0, "V": 0}

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts of a partition in blocks of about `block_bytes`; a block's number is the partition's and its own."""
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            ends, first = np.cumsum(lengths), 0
            while first < len(batch):
                done = int(ends[first - 1]) if first else 0
                last = min(len(batch), max(first + 1, int(np.searchsorted(ends, done + block_bytes - size, "right"))))
                held.append(batch.slice(first, last - first))
                size, first = size + int(ends[last - 1]) - done, last
                if size >= block_bytes or first < len(batch):
                    yield from block_of(number, pa.Table.from_batches(held)).to_batches()
                    held, size, number = [], 0, number + 1
        if held:
            yield from block_of(number, pa.Table.from_batches(held)).to_batches()

    def block_of(number: int, rows: pa.Table) -> pa.Table:
        row, token = block_tokens(rows.column("text"))
        word, _, back = _distinct(token)
        rank = np.argsort(-np.bincount(back, minlength=len(word)), kind="stable")  # frequent words get small numbers
        place = np.empty(len(word), np.int64)
        place[rank] = np.arange(len(word))
        held = rows.column("held").to_numpy()
        n, none = np.bincount(row, minlength=rows.num_rows), np.zeros(0)
        own = {"word": word[rank], "count": np.bincount(place[back], ~held[row], len(word)), "token": place[back]}
        own |= {c: none for c in KEPT if c not in own}
        return _state(number, rows.column("id").combine_chunks(), {"held": held, "n_tokens": n, "n_known": np.zeros(rows.num_rows, np.int64), "base": np.zeros(rows.num_rows), "total": np.zeros(rows.num_rows)}, own)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _one_by_one(batches):
            kept = _kept(rows)
            order = np.argsort(kept["word"])
            word, count = kept["word"][order], kept["count"][order]
            own, cuts = np.unique(_bucket(word, blocks), return_index=True)
            data = [pack(x, (np.uint64, np.int64)) for x in zip(np.split(word, cuts[1:]), np.split(count, cuts[1:]), strict=True)] if len(own) else []
            yield from pa.table({"block": np.full(len(own), rows.column("block")[0].as_py(), np.int64), "bucket": own, "data": pa.array(data, pa.binary())}).to_batches()

    def count_words(key, rows):
        asked = [unpack(x, (np.uint64, np.int64)) for x in rows.column("data")]
        own, _, back = _distinct(np.concatenate([x for x, _ in asked]))
        total = np.bincount(back, np.concatenate([x for _, x in asked]), len(own)).astype(np.int64)
        often = np.flatnonzero(total >= MIN_NEXT)
        number = np.zeros(len(own), np.uint64)  # frequent words get small numbers, each bucket its own
        number[often[np.argsort(-total[often], kind="stable")]] = np.arange(len(often), dtype=np.uint64) * np.uint64(blocks) + np.uint64(key[0].as_py() + 1)
        cuts = np.cumsum([len(x) for x, _ in asked])[:-1]
        told = [pack(x, (np.int64, np.uint64)) for x in zip(np.split(total[back], cuts), np.split(number[back], cuts), strict=True)]
        return pa.table({"block": np.append(rows.column("block").to_numpy(), -1), "bucket": np.append(rows.column("bucket").to_numpy(), -1).astype(np.int32), "told": pa.array([*told, None], pa.binary()), "n": np.append(np.zeros(len(told), np.int64), total.sum()), "v": np.append(np.zeros(len(told), np.int64), (total > 0).sum())})

    def start(rows, told):
        kept = _kept(rows)
        count, number = np.zeros(len(kept["word"]), np.int64), np.zeros(len(kept["word"]), np.uint64)
        if told.num_rows:  # words were asked for in the order of their hashes
            order, lists = np.argsort(kept["word"]), [unpack(x, (np.int64, np.uint64)) for x in told.sort_by("bucket").column("told")]
            count[order], number[order] = (np.concatenate(x) for x in zip(*lists, strict=True))
        row, each = np.repeat(np.arange(len(kept["n_tokens"])), kept["n_tokens"]), count[kept["token"]]
        total = lambda w: np.bincount(row, w, len(kept["n_tokens"]))
        logs = np.log10((each + 1) / (totals["N"] + totals["V"] + 1))
        kept |= {"n_known": total(each > 0).astype(np.int64), "base": total(logs), "total": total(np.where(each < MIN_NEXT, logs, 0.0))}
        often = count >= MIN_NEXT  # rarer words are neither counted nor contexts: from here they are one
        place = np.where(often, np.cumsum(often) - 1, often.sum())
        kept |= {"word": number[often], "count": count[often], "token": place[kept["token"]]}
        return _state(rows.column("block")[0].as_py(), _ids(rows), {c: kept[c] for c in DOCS}, kept)

    parts = min(PARTS, blocks)
    part = _part(parts)
    tokenised = materialise(base.mapInArrow(tokens, schema).select("*", part), "lm-tokens", ["part"], rows_check=4)
    asked = tokenised.mapInArrow(ask_words, ASK)
    counted = _dealt_out(asked, blocks).applyInArrow(count_words, "block long, bucket int, told binary, n long, v long")
    answers = materialise(counted.select("*", part), "lm-words", ["part"])
    got = answers.where("part < 0").agg(F.sum("n").alias("N"), F.sum("v").alias("V")).first()
    totals = {"N": int(got["N"] or 0), "V": int(got["V"] or 0)}
    state = []
    for folder in sorted({f.rpartition("/")[0] for f in tokenised.inputFiles()}):
        own, number = spark.read.schema(schema).parquet(folder), int(folder.rpartition("=")[2])
        state.append((number, _answered(own, answers.where(F.col("part") == number), start, schema, blocks, parts)))
        discard(own)
    state = state or [(0, tokenised.drop("part"))]
    discard(answers)

    for level in range(1, depth + 1):
        asked = _all(state).agg(F.sum("open")).first()[0] or 0
        if not asked:
            break
        state = _grow(state, parts, schema, totals, level, blocks, max(1, math.ceil(asked * (FIRST_ASKED / FIRST_SHARE if level == 1 else ASKED / PASS_SHARE) / max(1, size))), level == depth, hot)

    state = _all(state)
    left = state.agg(F.sum(F.size("id"))).first()[0] or 0
    if left != given:
        raise RuntimeError(f"{given} documents came in and {left} were scored")
    out = state.selectExpr("inline(arrays_zip(id, held, n_tokens, n_known, base, total))")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(totals["N"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("total").alias("score"))


def _ids(rows: pa.Table) -> pa.Array:
    return rows.column("id").combine_chunks().flatten()


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for k in range(len(batch)):
            yield pa.Table.from_batches([batch.slice(k, 1)])


def _all(state: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.union, [blocks for _, blocks in state])


def _part(parts: int) -> Column:
    """The part of a block; -1 for rows that go to no block."""
    return F.when(F.col("block") < 0, -1).otherwise(F.pmod(F.xxhash64("block"), F.lit(parts))).cast("int").alias("part")


def _dealt_out(asked: DataFrame, blocks: int):
    return asked.repartition(max(1, blocks // BUCKETS_A_TASK), "bucket").groupBy("bucket")


def _answered(state: DataFrame, told: DataFrame, advance, schema: str, blocks: int, parts: int) -> DataFrame:
    """One part of the blocks, each with what it was told."""
    by_block = lambda df: df.repartition(max(1, blocks // parts), "block").groupBy("block")
    return materialise(by_block(state).cogroup(by_block(told)).applyInArrow(advance, schema), "lm-blocks", rows_check=4)


def _grow(state: list[tuple[int, DataFrame]], parts: int, schema: str, totals: dict, level: int, blocks: int, passes: int, last: bool, most: int) -> list[tuple[int, DataFrame]]:
    """The blocks after contexts of `level` words were judged: chances refined, positions with no longer context closed.

    `state` has the parts that hold blocks, each with its number among all `parts`.
    """
    smallest, buckets = 1 / (totals["N"] + totals["V"] + 1), blocks * passes

    def dealt(rows: pa.Table, *pass_: int) -> tuple[Dealt, np.ndarray]:
        kept, final = _kept(rows), 0.0
        if level == 1:
            columns, final = _first_level(kept, smallest)
            kept |= columns
        return Dealt(kept, buckets, most, *pass_), final

    def ask(part: int):
        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _one_by_one(batches):
                yield from dealt(rows, passes, part)[0].ask(rows.column("block")[0].as_py()).to_batches()

        return asked

    def judge(key, rows):
        return _judge(rows, last, most)

    def advance(rows, told):
        own, first = dealt(rows)
        columns, final = _next_level(own, told, last)
        kept = own.kept | {"count": np.zeros(0), "token": np.zeros(0)} | columns
        kept["total"] = kept["total"] + first + final
        return _state(rows.column("block")[0].as_py(), _ids(rows), {c: kept[c] for c in DOCS}, kept)

    found = []
    for part in range(passes):
        asked = _dealt_out(_all(state).mapInArrow(ask(part), ASK), blocks).applyInArrow(judge, FOUND)
        found.append(materialise(asked.select("*", _part(parts)), f"lm-strings{level}", ["part"]))
    every = reduce(DataFrame.union, found)
    hot = every.where("part < 0")
    verdict = hot.groupBy("context").agg(F.when(F.sum("gain") >= GAIN, 1 - F.sum("share") / F.first("occurs")).otherwise(0.0).alias("rest"))
    verdict = hot.select("context", F.explode("blocks").alias("block")).distinct().join(verdict, "context").groupBy("block").agg(F.collect_list(F.struct("context", "rest")).alias("x"))
    verdict = verdict.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("told"), F.col("x.context").alias("contexts"), F.col("x.rest").alias("rests"))
    verdict = materialise(verdict, "lm-verdicts")  # every part asks for it
    grown = []
    for part, old in state:
        told = every.where(F.col("part") == part).select("block", "bucket", "told").unionByName(verdict.where(_part(parts) == part), allowMissingColumns=True)
        grown.append((part, _answered(old, told, advance, schema, blocks, parts)))
        discard(old)
    for table in [*found, verdict]:
        discard(table)
    return grown


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_corpus(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
