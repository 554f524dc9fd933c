"""Packing token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program covers every length's count
with as few configurations as it can; it is solved by multiplicative weights, whose pricing problem is a
knapsack over 2048 capacities. The fractional counts are rounded without covering anything twice, the program is
solved again over what that leaves, and so on; the last few items are filled in by exact subset sums. Driver and broadcasts see lengths, counts and configurations
only: their sizes depend on the capacity, not on the corpus. Documents find their places by rank within
their length, which needs no sort of a whole length: tasks number their own rows, and an offset by task
and length is joined on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed
from tickloom.llm.tokens import Vocabulary, encoder
from tickloom.ship import in_arrow

CAPACITY = 2048
END = b"\0\0\0\0"
Config = tuple[tuple[int, int], ...]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, own_rank long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, the first piece taking what is over."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, numbered within their task and length."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(shared.value).encode, np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + END
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "own_rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, PIECES)


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for every capacity the best value and the length to take first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        k = np.searchsorted(lengths, c, side="right")
        total = values[:k] + best[c - lengths[:k]]
        i = k - 1 - int(np.argmax(total[::-1]))  # of equal ones the longest: short items fill more gaps later
        if total[i] > best[c - 1]:
            best[c], take[c] = total[i], lengths[i]
        else:
            best[c] = best[c - 1]
    return best, take


def _filled(first: int, take: np.ndarray, capacity: int) -> Config:
    config, left = {first: 1}, capacity - first
    while left > 0:
        if take[left]:
            config[int(take[left])] = config.get(int(take[left]), 0) + 1
            left -= int(take[left])
        else:
            left -= 1
    return tuple(sorted(config.items(), reverse=True))


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = 60, width: int = 64, eta: float = 0.7, slack: float = 0.02) -> dict[Config, float]:
    """Fractional configuration counts by multiplicative weights.

    A length's weight starts at its share of all tokens and shrinks with the share of its count that is
    covered. Each round prices once; from the optimum's table come up to `width` configurations, each built
    on one of the lengths covered least, whose value is within `slack` of the best.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths], dtype=float)
    place = {int(x): i for i, x in enumerate(lengths)}
    covered, x = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        value = lengths * np.exp(-eta * (covered - covered.min())) + 1e-9
        best, take = price(lengths, value, capacity)
        offered = value + best[capacity - lengths]
        good = np.flatnonzero(offered >= (1 - slack) * best[capacity])
        for i in good[np.argsort(covered[good], kind="stable")][:width]:
            config = _filled(int(lengths[i]), take, capacity)
            step = min(need[place[n]] / a for n, a in config)
            x[config] = x.get(config, 0.0) + step
            for n, a in config:
                covered[place[n]] += step * a / need[place[n]]
    return x


def _subset(target: int, left: dict[int, int], lengths: list[int]) -> list[int]:
    """Lengths, each at most as often as it is left, whose sum comes closest to `target` from below.

    `lengths` run from long to short; the sums stop growing once the target is met, which spares short ones.
    """
    reach, history = 1, []
    mask = (1 << (target + 1)) - 1
    for n in lengths:
        history.append(reach)
        many, size = min(left[n], target // n), 1
        while many > 0:
            some = min(size, many)
            reach |= (reach << (some * n)) & mask
            many -= some
            size *= 2
        if reach >> target & 1:
            break
    total, out = reach.bit_length() - 1, []
    for n, before in zip(reversed(lengths[: len(history)]), reversed(history), strict=True):
        while not before >> total & 1:
            out.append(n)
            total -= n
    return out


def _rounded(left: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Whole configuration counts from the program over what is `left`, full configurations only.

    They are taken in the order of their fractional counts, rounded down without covering anything twice, but once at
    least where all their items are still there. `left` loses what they place.
    """
    x = solve(left, capacity)
    covered = dict.fromkeys(left, 0.0)
    for config, k in x.items():
        for n, a in config:
            covered[n] += k * a / left[n]
    placed = []
    for config, k in sorted(x.items(), key=lambda c: (-c[1], c[0])):
        if sum(n * a for n, a in config) == capacity:
            many = min(max(1, int(k / max(covered[n] for n, _ in config) + 1e-9)), *(left.get(n, 0) // a for n, a in config))
            if many > 0:
                placed.append((config, many))
                for n, a in config:
                    left[n] -= many * a
    for n in [n for n, k in left.items() if not k]:
        del left[n]
    return placed


def _rest(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Configurations for the few items that the program leaves: the longest first, filled up by exact subset sums."""
    left, plan = dict(counts), []
    for n in sorted(counts, reverse=True):
        while left[n]:
            left[n] -= 1
            small = sorted((m for m in left if left[m] > 0 and m <= capacity - n), reverse=True)
            rest = _subset(capacity - n, left, small)
            left[n] += 1
            config = tuple(sorted(((m, [n, *rest].count(m)) for m in {n, *rest}), reverse=True))
            many = min(left[m] // a for m, a in config)
            plan.append((config, many))
            for m, a in config:
                left[m] -= many * a
    return plan


def round_up(counts: dict[int, int], capacity: int = CAPACITY, patience: int = 4) -> tuple[list[tuple[Config, int]], list[tuple[Config, int]]]:
    """Whole configuration counts that place every item exactly once: those of the program, and those of the rest.

    The program is solved again over what its rounding leaves. Of these solutions as many are used as make for the
    fewest sequences with the rest; the search ends when `patience` solutions in a row have brought no gain.
    """
    left, plan, waited = dict(counts), [], 0
    rest = _rest(left, capacity)
    best = (sum(k for _, k in rest), [], rest)
    while left and waited < patience:
        placed = _rounded(left, capacity)
        if not placed:
            break
        plan = plan + placed
        rest = _rest(left, capacity)
        total = sum(k for _, k in plan + rest)
        waited = 0 if total <= best[0] else waited + 1
        if total <= best[0]:
            best = (total, plan, rest)
    return best[1], best[2]


def places(plan: list[tuple[Config, int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, number in a sequence, first sequence, offset), sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for config, k in plan:
        offset = 0
        for n, a in config:
            rows.append((n, ranks.get(n, 0), a, sequence, offset))
            ranks[n] = ranks.get(n, 0) + k * a
            offset += n * a
        sequence += k
    out = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of every document.

    A null or empty text is one token, the end id. Repeated rows are packed each for itself; a null doc_id
    stays null. No document: no row. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = checkpointed(pieces(docs, vocabulary or Vocabulary.load(), capacity))
    groups = checkpointed(rows.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    of_program, rest = round_up(counts, capacity)
    shared = spark.sparkContext.broadcast(places(of_program + rest, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(key, n << 48 | rank, side="right") - 1]
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at[:, 3] + k // at[:, 2]), pa.array(at[:, 4] + k % at[:, 2] * n)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return in_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
