"""Byte-level BPE by a rank queue: encoding of whole texts and decoding of their ids.

A text is split into pre-tokens by the vocabulary's pattern. A pre-token that is no token itself starts as a linked
list of bytes; the queue has a bucket for each merge rank with the positions whose pair has that rank, and a bitmap of
the buckets that are not empty, with a bitmap of its words above it, so that the lowest rank is found by a
find-first-set at each level. A merge puts at most two new pairs into the queue; entries whose pair has changed
since are skipped when their turn comes. That is linear in the length of a pre-token, but for the order of positions
within a bucket. Each worker keeps the ids of short pre-tokens it has met, up to a bound.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tokens import Vocabulary
from tickloom.ship import in_arrow

#: Pre-tokens a worker remembers, and their longest.
REMEMBERED, SHORT = 400_000, 48
#: Characters of a text up to which its pre-tokens are listed at once.
AT_ONCE = 1 << 20


class RankQueue:
    """(rank, position) entries, lowest rank first and lowest position first within a rank.

    Two levels of bitmaps, as wide as they are many: a bit for each bucket, and above it a bit for each word of those.
    """

    def __init__(self, ranks: int):
        self.width = max(1, math.isqrt(max(0, ranks - 1)) + 1)
        self.bits = [1 << i for i in range(self.width)]
        self.word_of = [rank // self.width for rank in range(ranks)]
        self.bit_of = [self.bits[rank % self.width] for rank in range(ranks)]
        # of a rank: nothing, its one position, or a heap of two and more
        self.buckets: list[int | list[int] | None] = [None] * ranks
        self.words, self.top = [0] * self.width, 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = position
            word = self.word_of[rank]
            self.words[word] |= self.bit_of[rank]
            self.top |= self.bits[word]
        elif bucket.__class__ is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """The first entry, taken out; None where there is none."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        held = self.words[word]
        bit = (held & -held).bit_length() - 1
        rank = word * self.width + bit
        bucket = self.buckets[rank]
        if bucket.__class__ is not int:
            position = heappop(bucket)
            if len(bucket) == 1:
                self.buckets[rank] = bucket[0]
            return rank, position
        self.buckets[rank] = None
        self.words[word] = held = held ^ self.bits[bit]
        if not held:
            self.top = top ^ self.bits[word]
        return rank, bucket


class Bpe(dict):
    """Pre-token to its ids, as little-endian unsigned 32-bit numbers; made when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.lines.splitlines())}
        self.split = regex.compile(vocabulary.pattern)
        last = max(self.ranks.values(), default=-1)
        self.queue = RankQueue(last + 1)
        tokens = [b""] * (last + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the leftmost pair of the lowest rank is merged."""
        # push() and pop() of the queue are written out, as calls would take half of the time
        n, rank_of, queue = len(piece), self.ranks.get, self.queue
        width, bits, word_of, bit_of, buckets, words = queue.width, queue.bits, queue.word_of, queue.bit_of, queue.buckets, queue.words
        after, before, top = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        # the rank that the token here makes with the next one
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                bucket = buckets[rank]
                if bucket is None:
                    buckets[rank] = i
                    word = word_of[rank]
                    words[word] |= bit_of[rank]
                    top |= bits[word]
                elif bucket.__class__ is int:
                    buckets[rank] = [bucket, i]
                else:
                    # positions come in order, so this is a heap
                    bucket.append(i)
        while top:
            first = top & -top
            word = first.bit_length() - 1
            held = words[word]
            bit = held & -held
            rank = word * width + bit.bit_length() - 1
            bucket = buckets[rank]
            if bucket.__class__ is not int:
                i = heappop(bucket)
                if len(bucket) == 1:
                    buckets[rank] = bucket[0]
            else:
                i = bucket
                buckets[rank] = None
                words[word] = held = held ^ bit
                if not held:
                    top ^= first
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = None
            if end < n:
                before[end] = i
                pair[i] = rank = rank_of(piece[i : after[end]])
                if rank is not None:
                    bucket = buckets[rank]
                    if bucket is None:
                        buckets[rank] = i
                        word = word_of[rank]
                        words[word] |= bit_of[rank]
                        top |= bits[word]
                    elif bucket.__class__ is int:
                        buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                    else:
                        heappush(bucket, i)
            if i:
                left = before[i]
                pair[left] = rank = rank_of(piece[left:end])
                if rank is not None:
                    bucket = buckets[rank]
                    if bucket is None:
                        buckets[rank] = left
                        word = word_of[rank]
                        words[word] |= bit_of[rank]
                        top |= bits[word]
                    elif bucket.__class__ is int:
                        buckets[rank] = [bucket, left] if bucket < left else [left, bucket]
                    else:
                        heappush(bucket, left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = self.merge(raw) if rank is None else [rank]
        ids = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers; none for null."""
        if not text:
            return b""
        pieces: Iterable[str] = self.split.findall(text) if len(text) <= AT_ONCE else (m[0] for m in self.split.finditer(text))
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for; none for null. An id outside the vocabulary is an error."""
        at = np.frombuffer(ids or b"", dtype="<u4")
        if len(at) and (at.max() >= len(self.lengths) or not self.lengths[at].all()):
            raise ValueError("an id is not of the vocabulary")
        out = []
        for part in (at[k : k + AT_ONCE] for k in range(0, len(at), AT_ONCE)):
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_known: dict[str, Bpe] = {}


def bpe(vocabulary: Vocabulary) -> Bpe:
    """One for each version of a vocabulary in each worker process."""
    if vocabulary.version not in _known:
        _known[vocabulary.version] = Bpe(vocabulary)
    return _known[vocabulary.version]


def _over(rows: DataFrame, vocabulary: Vocabulary, method: str, column: str, out: str) -> DataFrame:
    """Each row's `column` put through a method of `Bpe`, as the column `out` after the others."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = getattr(bpe(shared.value), method)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            kept = [k for k in range(batch.num_columns) if k != at]
            made = pa.array([of(x.as_py()) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), made], names=[*(batch.schema.names[k] for k in kept), out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != column)
    return in_arrow(rows, run, f"{kept}, {out} binary")


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text, little-endian unsigned 32-bit numbers in one binary value.

    Null and empty texts have none of them (an empty value). Repeated rows and rows without a doc_id are encoded each
    for itself; an empty table gives an empty table; extra columns are ignored. Special tokens are ordinary text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _over(rows, vocabulary or Vocabulary.load(), "encode", "text", "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The rows of `encoded` (ids and others) with `decoded`, the bytes of their ids, in place of `ids`; null ids give no bytes."""
    return _over(encoded, vocabulary or Vocabulary.load(), "decode", "ids", "decoded")


def round_trip(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of `docs`; see `encode` for nulls and repeated rows."""
    vocabulary = vocabulary or Vocabulary.load()
    encoded = encode(docs, vocabulary).select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(encoded, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
