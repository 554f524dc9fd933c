"""Near-duplicate documents by 64-bit SimHash fingerprints and anchor-point covering.

The anchors are a covering code, a direct sum of perfect codes: two binary Golay codes (radius 3) on fingerprint
bits 0-22 and 23-45 and, where there are more fingerprints than those 2^24 anchors can part, a Hamming code
(radius 1) on bits 46-60 with bits 61-63 as they are, which makes 2^38. Every fingerprint lies within the radius
of its home anchor in each block. Two fingerprints that differ in at most t = 2 bits meet at the home
anchor of either one, if every fingerprint is replicated to all anchors within radius plus threshold: to
the words at distance at most radius + e in each block, the e of all blocks summing to 2 at most. These are
about 61 of 2^24, or 153 of 2^38.

Exact copies share one fingerprint row, so a large group of copies costs one row. Anchors at home to more
than `crowd` fingerprints are not compared pair by pair: a link between two such fingerprints is found by
the words one bit away from each (two words differ in at most 2 bits just when they share a neighbour at
distance 0 or 1), where everything that meets is linked, so a star of links says it all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import LOWER_ASCII, checkpointed, join_by_key
from tickloom.llm.components import components
from tickloom.ship import in_arrow

THRESHOLD = 2
#: Blocks of the covering code: bits, generator polynomial, covering radius, bits behind it that are taken as they are.
GOLAY = (23, 0b110001110101, 3, 0)
HAMMING = (15, 0b10011, 1, 3)
#: Beyond this number of fingerprints to an anchor the third block is used.
FULL = 4
SHINGLE = 3
SEED = 42
#: From here on, nodes stand for fingerprints of which no row has a doc_id; doc_ids are smaller.
NAMELESS = 1 << 62


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of a whole text in UTF-8; zero where it has no word."""
    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = [digest(join(words[i : i + SHINGLE]), SEED) for i in range(max(1, len(words) - SHINGLE + 1))]
    counts = np.zeros(64, dtype=np.int64)
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 14):
        counts += np.unpackbits(raw[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.array([fingerprint(x.as_py()) for x in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) for every row; null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, _fingerprints, "doc_id long, fp long")


def blocks_for(fingerprints: int) -> int:
    """Blocks of the code: enough for fewer than FULL fingerprints to an anchor."""
    return 2 if fingerprints <= FULL << 24 else 3


@lru_cache(4)
def patterns(block: tuple[int, int, int, int], threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: words with that syndrome, what each costs (99: no word), and the syndromes of single bits.

    y XOR a pattern of y's syndrome is an anchor's word; cost is its distance over the covering radius.
    """
    size, generator, radius, free = block
    degree = generator.bit_length() - 1
    unit = []
    for bit in range(size):
        rest = 1 << bit
        for k in range(size - 1, degree - 1, -1):
            if rest >> k & 1:
                rest ^= generator << (k - degree)
        unit.append(rest)
    unit += [0] * free
    found = []
    for weight in range(radius + threshold + 1):
        for bits in combinations(range(size), weight):
            syndrome = reduce(xor, (unit[b] for b in bits), 0)
            for flips in range(threshold - max(weight - radius, 0) + 1):
                found += [(syndrome, max(weight - radius, 0) + flips, sum(1 << b for b in (*bits, *more))) for more in combinations(range(size, size + free), flips)]
    table = np.array(sorted(found), dtype=np.int64)
    counts = np.bincount(table[:, 0], minlength=1 << degree)
    words, costs = np.zeros((1 << degree, counts.max()), np.int64), np.full((1 << degree, counts.max()), 99)
    column = np.arange(len(table)) - np.repeat(np.cumsum(counts) - counts, counts)
    words[table[:, 0], column], costs[table[:, 0], column] = table[:, 2], table[:, 1]
    return words, costs, np.array(unit)


def anchors(prints: np.ndarray, threshold: int = THRESHOLD, blocks: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replicas as (row, anchor, is_home): for each fingerprint its anchors within radius plus threshold."""
    row, anchor, spent, start = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64), 0
    for block in (GOLAY, GOLAY, HAMMING)[:blocks]:
        words, costs, unit = patterns(block, threshold)
        part = prints >> start & ((1 << len(unit)) - 1)
        syndrome = reduce(xor, (np.where(part >> bit & 1, unit[bit], 0) for bit in range(len(unit))))
        k, j = np.nonzero(costs[syndrome[row]] + spent[:, None] <= threshold)
        of = syndrome[row[k]]
        anchor, spent = anchor[k] | (part[row[k]] ^ words[of, j]) << start, spent[k] + costs[of, j]
        row, start = row[k], start + len(unit)
    return row, anchor, spent == 0


def _replicas(threshold: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "fp", "node", "home"]
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), 1024):
                some, ids = prints[at : at + 1024], nodes[at : at + 1024]
                row, anchor, home = anchors(some, threshold, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(some[row]), pa.array(ids[row]), pa.array(home)], names=names)

    return run


def links(prints: DataFrame, threshold: int = THRESHOLD, crowd: int = 16, blocks: int = 2) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most `threshold` bits.

    `prints` has one row (fp, node) for each distinct fingerprint. Every close pair is linked directly, or
    both are linked to a third node that is close to each. No pair of a crowded anchor is listed.
    """
    if threshold != 2:
        raise ValueError("crowded anchors are resolved for a threshold of 2")
    replicas = in_arrow(prints.select("fp", "node"), _replicas(threshold, blocks), "anchor long, fp long, node long, home boolean")
    homes = checkpointed(replicas.where("home").select("anchor", "fp", "node"))
    busy = homes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor")
    quiet = homes.join(busy, "anchor", "left_anti").select("anchor", F.col("fp").alias("fp1"), F.col("node").alias("a"))
    near = F.bit_count(F.col("fp1").bitwiseXOR(F.col("fp"))) <= threshold
    compared = quiet.join(replicas.select("anchor", "fp", F.col("node").alias("b")), "anchor").where(near & (F.col("fp1") != F.col("fp"))).select("a", "b")
    crowded = homes.join(busy, "anchor", "left_semi").select("fp", "node")
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    around = crowded.select("node", F.explode(flips).alias("word"))
    least = around.groupBy("word").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, "word").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return compared.union(stars)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of `docs` (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id that links of at most `threshold` differing bits reach, the row's
    own included. Null and wordless texts have the zero fingerprint, linked like any other. Repeated rows
    each have a row. Rows with a null doc_id have a fingerprint; they name no component, so component_id is
    the smallest doc_id that is not null, or null where there is none.
    """
    rows = checkpointed(fingerprints(docs))
    nameless = F.xxhash64("fp").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).select("fp", F.coalesce("least", nameless).alias("node"), "n"))
    many, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    linked = components(links(nodes, threshold, blocks=blocks_for(many)))
    smallest = F.coalesce("component", "node")
    known = nodes.join(linked, "node", "left").select("fp", "n", F.when(smallest < NAMELESS, smallest).alias("component_id"))
    return join_by_key(rows, known, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, without near-duplicates: of each group the row with the smallest doc_id.

    Of several such rows with one fingerprint one is kept; where rows of other groups share the doc_id, theirs is
    judged by their own group. Rows without a doc_id are kept only where their group has no row with one, and then
    one of them for each fingerprint.
    """

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = row.field(row.type.get_field_index("text")).cast(pa.string()).cast(pa.binary())
            yield batch.append_column("print", pa.array([f"{fingerprint(x.as_py()):016x}" for x in texts], pa.string()))

    found = checkpointed(near_duplicates(docs, threshold))
    keep = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept"), F.col("fingerprint").alias("of")).distinct()
    # whole rows go along as one column, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    tagged = in_arrow(rows, tag, T.StructType([*rows.schema.fields, T.StructField("print", T.StringType())]))
    some = tagged.join(keep, F.col("id").eqNullSafe(F.col("kept")) & (F.col("print") == F.col("of")), "left_semi")
    return some.dropDuplicates(["id", "print"]).select("row.*")
