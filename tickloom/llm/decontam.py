"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows of `WINDOW` characters. A region of a document within k
edits of a window shares at least len - q + 1 - kq of its q-grams, and they lie on diagonals at most k apart;
so shared q-grams are counted by window in overlapping diagonal bands (2k wide, k apart), bands that meet
the bound are kept, those side by side are joined, and each is verified by banded alignment. Both sides are
compared in lower case with runs of white space as one space. The benchmark is broadcast in blocks of bounded
size: documents are never shuffled, and a larger benchmark means more passes. Counting goes by stretches of the
text and ranges of windows, so repetitive texts need no more memory than others.

Windows begin every STRIDE characters, so any verbatim excerpt of WINDOW + STRIDE - 1 characters holds one.
Items shorter than WINDOW are searched whole, with as many edits as the lemma's bound leaves; with none, they
must stand on word bounds. Items of fewer than Q characters cannot be searched: `unsearched` lists them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.ship import in_arrow

Q = 10
WINDOW, STRIDE = 80, 20
#: Edits allowed in a window of WINDOW characters; in proportion for shorter items, as far as the lemma bears.
EDITS = 5
#: Characters of a text, and pairs of equal q-grams, that are counted at once.
STRETCH, PAIRS = 4096, 1_000_000
BLOCK_CHARS = 4_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
#: Lower case of the first 65,536 code points where it is one code point; white space as a space.
FOLDED = np.array([32 if chr(i).isspace() else ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(1 << 16)], dtype=np.uint32)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with runs of white space as one space, and where each stood in the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = FOLDED[np.minimum(points, 0xFFFF)] + np.where(points > 0xFFFF, points - 0xFFFF, 0)
    space = points == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return points[at].astype(np.uint32), at


def grams(points: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams (q = 10) at each position; equal q-grams have equal hashes."""
    p = points.astype(np.uint64)
    if len(p) < Q:
        return p[:0]
    two = p[:-1] * PRIME + p[1:]
    five = (two[:-3] * PRIME + two[2:-1]) * PRIME + p[4:]
    mixed = five[:-5] * (PRIME ^ np.uint64(0x5555)) + five[5:]
    return mixed ^ mixed >> np.uint64(29)


@dataclass(frozen=True)
class Window:
    """A stretch of one item, or of several that have the same."""

    items: tuple[int, ...]
    points: np.ndarray
    edits: int
    least: int


@dataclass(frozen=True)
class Index:
    """Windows of one block of the benchmark with their q-grams sorted by hash, and a filter of the hashes.

    `key` numbers the distinct hashes and holds the window in its lower part: q-grams of a range of windows that
    have one hash are next to each other.
    """

    windows: list[Window]
    hashes: np.ndarray
    key: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    width: np.ndarray
    need: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Index:
        of: dict[bytes, dict[int, None]] = {}
        for item, text in sorted(items):
            points = normalise(text.strip())[0]
            if len(points) < Q:
                continue
            starts = list(range(0, max(1, len(points) - WINDOW + 1), STRIDE))
            if starts[-1] + WINDOW < len(points):
                starts.append(len(points) - WINDOW)
            for s in starts:
                of.setdefault(points[s : s + WINDOW].tobytes(), {})[item] = None
        windows: list[Window] = []
        for raw, owners in of.items():
            part = np.frombuffer(raw, np.uint32)
            edits = min(EDITS * len(part) // WINDOW, (len(part) - Q) // Q)
            windows.append(Window(tuple(owners), part, edits, len(part) - Q + 1 - edits * Q))
        made = [grams(w.points) for w in windows]
        hashes = np.concatenate(made) if made else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(windows)), [len(m) for m in made])
        place = np.concatenate([np.arange(len(m)) for m in made]) if made else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        number = np.cumsum(np.r_[0, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        width, need = (np.array([f(w) for w in windows], dtype=np.int64) for f in (lambda w: max(1, w.edits), lambda w: w.least))
        return Index(windows, hashes, number * max(1, len(windows)) + owner, owner, place[order], table, width, need)

    def candidates(self, hashed: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, first diagonal, width) of the joined bands whose counts meet the window's bound."""
        hit = self.filter[(hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        fewest = int(self.need.min())
        if hit.sum() < fewest:
            return []
        # a region that could match holds enough hits within one window's reach
        total = np.concatenate([[0], np.cumsum(hit)])
        reach = WINDOW + EDITS
        ahead = total[np.minimum(np.arange(len(hit)) + reach, len(hit))] - total[:-1]
        start = np.flatnonzero(ahead >= fewest)
        if not len(start):
            return []
        dense = np.zeros(len(hit) + 1, dtype=np.int64)
        np.add.at(dense, start, 1)
        np.add.at(dense, np.minimum(start + reach, len(hit)), -1)
        at = np.flatnonzero(hit & (np.cumsum(dense)[:-1] > 0))
        low = np.minimum(np.searchsorted(self.hashes, hashed[at]), len(self.hashes) - 1)
        met = self.hashes[low] == hashed[at]
        at, low = at[met], low[met]
        first = self.key[low] - self.owner[low]
        found = []
        # diagonals of one stretch come from positions up to a window and a band behind it
        for lead in range(-WINDOW - 2 * EDITS, int(at[-1]) + 1 if len(at) else 0, STRETCH):
            a, b = np.searchsorted(at, (lead, lead + STRETCH + WINDOW + 2 * EDITS))
            if a < b:
                found += self._counted(at[a:b], first[a:b], lead, 0, len(self.windows))
        if not found:
            return []
        owner, band = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((band, owner))
        owner, band = owner[order], band[order]
        cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (band[1:] > band[:-1] + 1)])
        ends = np.r_[cut[1:], len(owner)] - 1
        width = self.width[owner[cut]]
        return list(zip(owner[cut].tolist(), (band[cut] * width).tolist(), ((band[ends] - band[cut] + 2) * width).tolist(), strict=True))

    def _counted(self, at: np.ndarray, first: np.ndarray, lead: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(window, band) of windows low..high whose bands begin in the stretch at `lead` and hold enough q-grams."""
        a, b = np.searchsorted(self.key, first + low), np.searchsorted(self.key, first + high)
        many = b - a
        pairs = int(many.sum())
        if not pairs:
            return []
        if pairs > PAIRS and high - low > 1:
            middle = (low + high) // 2
            return self._counted(at, first, lead, low, middle) + self._counted(at, first, lead, middle, high)
        k = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(pairs)
        owner, place = self.owner[k], self.place[k]
        band = np.floor_divide(np.repeat(at, many) - place, self.width[owner])
        # a band of two widths: each q-gram is counted in the band that begins at its width and the one before
        owner, band, place = np.concatenate([owner, owner]), np.concatenate([band, band - 1]), np.concatenate([place, place])
        begin = band * self.width[owner] - lead
        here = (begin >= 0) & (begin < STRETCH)
        seen = np.unique(((owner[here] * STRETCH + begin[here]) << 7) | place[here])
        group, count = np.unique(seen >> 7, return_counts=True)
        enough = count >= self.need[group // STRETCH]
        owner = group[enough] // STRETCH
        return [(owner, (group[enough] % STRETCH + lead) // self.width[owner])] if len(owner) else []


def align(window: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> list[tuple[int, int, int]]:
    """Stretches of text on diagonals first..first + width that the whole window fits with at most `most` edits.

    Each is (edits, start, end), the best of those that end nearby. Paths may stray `most` diagonals off the band.
    Where one window fits at place after place (repetitive texts), these are one stretch.
    """
    low = first - most
    offsets = np.arange(width + 2 * most + 1)
    far = len(window) + len(text) + 1
    position = low + offsets  # text position before row 0 on each diagonal
    cost = np.where((position >= 0) & (position <= len(text)), 0, far)
    begin = position.copy()
    for row, point in enumerate(window):
        at = position + row  # text index read on each diagonal in this row
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(at), dtype=bool)
        same[inside] = text[at[inside]] == point
        match = cost + np.where(inside, ~same, far)
        skip = np.append(cost[1:] + 1, far)  # a window character with no partner: one diagonal down
        best = np.minimum(match, skip)
        source = np.where(match <= skip, begin, np.append(begin[1:], 0))
        # text characters with no partner run along the row
        run = np.minimum.accumulate(best - offsets)
        from_left = np.maximum.accumulate(np.where(best - offsets == run, offsets, -1))
        cost = np.where((at + 1 >= 0) & (at + 1 <= len(text)), run + offsets, far)
        begin = source[from_left]
    # level stretches of the costs that are lower than what is beside them
    cut = np.flatnonzero(np.r_[True, cost[1:] != cost[:-1]])
    last = np.r_[cut[1:], len(cost)] - 1
    level = cost[cut]
    beside = np.r_[far, level, far]
    end = np.where(last - cut > most, last, cut)
    return [(int(level[k]), max(0, int(begin[cut[k]])), int(position[end[k]] + len(window))) for k in np.flatnonzero((level <= most) & (level < beside[:-2]) & (level < beside[2:]))]


def verbatim(window: np.ndarray, text: np.ndarray, first: int, width: int) -> list[tuple[int, int, int]]:
    """What `align` returns for a single band, if the window stands unedited on one of its diagonals."""
    for at in range(max(0, first), first + width + 1):
        if np.array_equal(text[at : at + len(window)], window):
            return [(0, at, at + len(window))]
    return []


def _on_word_bounds(text: np.ndarray, start: int, end: int) -> bool:
    return not any(chr(p).isalnum() for p in (*text[max(0, start - 1) : start].tolist(), *text[end : end + 1].tolist()) if p < 0x110000)


def matches(text: str, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, end, edits) of each window of an item in the text, places being those of the normalised text."""
    points = normalise(text)[0]
    hashed = grams(points)
    for w, diagonal, width in index.candidates(hashed) if len(hashed) else []:
        window = index.windows[w]
        # a match is counted in two bands that overlap, so one alone makes three widths at most
        alone = width <= 4 * max(1, window.edits)
        for edits, start, end in (verbatim(window.points, points, diagonal, width) if alone else []) or align(window.points, points, diagonal, width, window.edits):
            if window.edits or _on_word_bounds(points, start, end):
                for item in window.items:
                    yield item, start, end, edits


def is_leak(text: str | None, index: Index) -> bool:
    """Whether the text holds a window of an item."""
    return bool(text and index.windows) and next(matches(text, index), None) is not None


def leaks(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) for each stretch of the text that holds windows of an item.

    Places are code points of the given text; windows of one item that overlap are one stretch, with the
    edits of its best window.
    """
    if not text or not index.windows:
        return []
    found: dict[int, list[tuple[int, int, int]]] = {}
    for item, *span in matches(text, index):
        found.setdefault(item, []).append(tuple(span))
    where = normalise(text)[1] if found else None
    out = []
    for item, spans in sorted(found.items()):
        spans.sort()
        start, end, edits = spans[0]
        for s, e, n in spans[1:]:
            if s <= end:
                end, edits = max(end, e), min(edits, n)
            else:
                out.append((item, int(where[start]), int(where[end - 1]) + 1, edits))
                start, end, edits = s, e, n
        out.append((item, int(where[start]), int(where[end - 1]) + 1, edits))
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes over all items, each over at most about `most` characters; null ids and texts are left out."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // most)
    for k in range(parts):
        yield Index.of([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()])


def unsearched(benchmark: DataFrame) -> DataFrame:
    """The rows of `benchmark`, all columns, that the lemma cannot search for: null, or too short once normalised."""
    text = F.trim(F.regexp_replace(F.col("text").cast("string"), r"\s+", " "))
    return benchmark.where(F.col("item_id").isNull() | F.col("text").isNull() | (F.length(text) < Q))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: every stretch of a document that holds benchmark text.

    Documents without a leak, and null and empty texts, have no row; repeated rows each have theirs. Items
    of fewer than 10 characters (see `unsearched`), null items and an empty benchmark match nothing. Extra columns
    are ignored.
    """
    schema = "doc_id long, item_id long, start long, end long, edits int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [(i.as_py(), *hit) for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for hit in leaks(t.as_py(), shared.value)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else [[]] * 5, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        found.append(in_arrow(rows, run, schema))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no benchmark text; nothing is shuffled.

    Null and empty texts stay, and all rows where the benchmark is empty. Repeated rows are judged like any.
    """
    out = docs
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not is_leak(t.as_py(), shared.value) for t in batch.column("text")], pa.bool_()))

        out = in_arrow(out, run, out.schema)
    return out
