"""Ranked lexical search over a tiered index.

The index has one row a document, and for each tier two lists: the terms whose postings fall into that tier, and their
impacts. A term's postings of highest impact make its first tier, of some thousand postings; each further tier holds
`GROWTH` times as many, and the last one the rest. Tiers are columns, so a search that stops early reads no others.
A term's residual bound at a tier is the highest impact that it has below.

An item is first ranked by its terms' first tiers. The k-th best of these partial scores is a floor for the k-th best
score; where it is above what a document could have that stands in none of those postings, only documents met so far
can be among the best, and of these only the ones whose partial score plus bounds reaches the floor are scored in
full. An item without that proof falls to the next tier; at the last one all postings are read and nothing is left
to prove. Scores are sums of integers, so results are the same at any number of tiers and tasks.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, shared_dir, slices
from tickloom.ship import in_arrow

#: Postings of a term in its first tier, at most, and how many times more each further tier holds.
FIRST, GROWTH = 1_000, 32
#: Impacts are counted by steps of 2 ** STEP.
STEP = 13
#: Bytes of a text split at once; characters of items searched for together; sums held at once.
AT_ONCE, BLOCK_CHARS, CELLS = 4_000_000, 4_000_000, 1 << 20
#: What stands for a null doc_id in orders: before all others.
NO_ID = -(1 << 63)
#: A-Z to a-z, all other ASCII but digits and letters to space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
HITS = "item int, row long, doc_id long, score long"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a few megabytes at a time."""
    for part in slices(text.encode().translate(TABLE), AT_ONCE):
        yield part.split(b" ")


def counts_of(text: str | None) -> Counter:
    found: Counter = Counter()
    for part in terms_of(text or ""):
        found.update(part)
    found.pop(b"", None)
    return found


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """row, doc_id, n, terms, tfs: of each document with a term at all, which of `terms` it holds and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for batch in batches:
            ids, ns, held, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n, parts = 0, [np.zeros(0, dtype=np.int64)]
                for words in terms_of(text.as_py() or ""):
                    n += len(words) - words.count(b"")
                    parts.append(np.array([t for t in map(find, words) if t is not None], dtype=np.int64))
                if n:
                    own, tf = np.unique(np.concatenate(parts), return_counts=True)
                    ids.append(doc_id), ns.append(n), held.append(own), tfs.append(tf)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), _lists(held, pa.int32()), _lists(tfs, pa.int64())], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, n long, terms array<int>, tfs array<long>").withColumn("row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Asked:
    """Items by term: for the term t, the entries at `start[t]` and the `count[t]` - 1 after it, each an item and its weight."""

    start: np.ndarray
    count: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    size: int

    @staticmethod
    def of(items: list[dict[int, int]], weights: np.ndarray, chosen: np.ndarray) -> Asked:
        """`items`: a term's number of times by item. Items that are not `chosen` have no entry, but keep their number."""
        rows = sorted((t, i, int(weights[t]) * k) for i in np.flatnonzero(chosen).tolist() for t, k in items[i].items())
        term, item, weight = (np.array(x, dtype=np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), ())))
        count = np.bincount(term, minlength=len(weights)).astype(np.int64)
        return Asked(np.cumsum(count) - count, count, item, weight, len(items))

    def sums(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Weight times value, summed by document and item."""
        out, n = np.zeros(docs * self.size, dtype=np.int64), self.count[term]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[term] - ends + n, n)
        np.add.at(out, np.repeat(doc * self.size, n) + self.item[at], np.repeat(value, n) * self.weight[at])
        return out.reshape(docs, self.size)


class Best:
    """The k best rows of each item so far: highest score first, then lowest doc_id, then lowest row."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}

    def add(self, scores: np.ndarray, doc_id: np.ndarray, row: np.ndarray) -> None:
        """scores: documents by items; what is below 1 is nothing."""
        doc, item = np.nonzero(scores >= self.floor)
        by = np.argsort(item, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(item[by])) + 1) if len(by) else []:
            i, d = int(item[part[0]]), doc[part]
            new = np.stack([-scores[d, i], doc_id[d], row[d]])
            held = np.concatenate([self.rows[i], new], axis=1) if i in self.rows else new
            self.rows[i] = held = held[:, np.lexsort(held[::-1])[: self.k]]
            if held.shape[1] == self.k:
                self.floor[i] = max(1, -held[0, -1])

    def batch(self) -> pa.RecordBatch:
        item = np.concatenate([np.zeros(0, dtype=np.int64), *(np.full(r.shape[1], i) for i, r in self.rows.items())])
        score, doc_id, row = np.concatenate([np.zeros((3, 0), dtype=np.int64), *self.rows.values()], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(row), pa.array(doc_id, pa.int64(), mask=doc_id == NO_ID), pa.array(-score)], names=["item", "row", "doc_id", "score"])


def _flat(batch: pa.RecordBatch, tiers: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, impact) of the batch's postings in the given tiers."""
    parts = []
    for t in tiers:
        terms, impacts = batch.column(f"terms_{t}"), batch.column(f"impacts_{t}")
        doc = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
        parts.append((doc, terms.flatten().to_numpy().astype(np.int64), impacts.flatten().to_numpy().astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _chunks(batches: Iterator[pa.RecordBatch], items: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    size = max(1, CELLS // max(items, 1))
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            yield part, part.column("doc_id").fill_null(NO_ID).to_numpy(), part.column("row").to_numpy()


class TieredIndex:
    """An index of all documents over the terms asked for, in a folder that all executors share."""

    def __init__(self, docs: DataFrame, terms: list[bytes], first: int = FIRST, growth: int = GROWTH):
        self.spark: SparkSession = docs.sparkSession
        self.terms = {t: i for i, t in enumerate(terms)}
        self.folder = f"{shared_dir(self.spark)}/lexical-{uuid.uuid4().hex}"
        postings(docs, self.terms).write.parquet(f"{self.folder}/postings")
        plain = self.spark.read.parquet(f"{self.folder}/postings")
        n, length = plain.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.documents, size = n, len(terms)
        impact = f"cast((1000000000 * p.tfs) div (1000 * p.tfs + 12 * (75 + (25 * n * {n}L) div {max(length, 1)}L)) as int)"
        each = plain.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), F.expr(impact).alias("impact"))
        steps = each.groupBy("term", F.shiftright("impact", STEP).alias("step")).agg(F.count("*").alias("postings"), F.max("impact").alias("most")).toPandas()
        # bounded: a few hundred steps of impact for each term asked for
        steps = steps.sort_values(["term", "step"], ascending=[True, False])
        df = np.zeros(size, dtype=np.int64)
        np.add.at(df, steps["term"].to_numpy(), steps["postings"].to_numpy())
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        above = steps.groupby("term")["postings"].cumsum().to_numpy()
        limits = [first]
        while limits[-1] < df.max(initial=0):
            limits.append(limits[-1] * growth)
        self.tiers = len(limits)
        #: by tier and term: the least impact that tiers up to it hold, and the highest that they don't.
        self.least, self.bound = np.full((self.tiers, size), 1 << 40, dtype=np.int64), np.zeros((self.tiers, size), dtype=np.int64)
        term, step, most = (steps[c].to_numpy().astype(np.int64) for c in ("term", "step", "most"))
        for t, limit in enumerate(limits):
            inside = above <= limit
            np.minimum.at(self.least[t], term[inside], step[inside] << STEP)
            np.maximum.at(self.bound[t], term[~inside], most[~inside])
        self._write(plain, n, max(length, 1))
        self.table = self.spark.read.parquet(f"{self.folder}/tiers")

    def _write(self, plain: DataFrame, n: int, length: int) -> None:
        shared, tiers = self.spark.sparkContext.broadcast(self.least), range(self.tiers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = shared.value
            for batch in batches:
                terms, tfs = batch.column("terms"), batch.column("tfs")
                counts = np.diff(terms.offsets.to_numpy())
                doc = np.repeat(np.arange(len(terms)), counts)
                term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                m = 75 + 25 * batch.column("n").to_numpy() * n // length
                impact = 10**9 * tf // (1000 * tf + 12 * m[doc])
                tier = (impact < least[:, term]).sum(axis=0)
                columns = [batch.column("row"), batch.column("doc_id")]
                for t in tiers:
                    own = tier == t
                    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[own], minlength=len(terms)))]), pa.int32())
                    columns += [pa.ListArray.from_arrays(ends, pa.array(x[own], pa.int32())) for x in (term, impact)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *(f"{c}_{t}" for t in tiers for c in ("terms", "impacts"))])

        lists = ", ".join(f"terms_{t} array<int>, impacts_{t} array<int>" for t in tiers)
        in_arrow(plain.select("row", "doc_id", "n", "terms", "tfs"), run, f"row long, doc_id long, {lists}").write.parquet(f"{self.folder}/tiers")

    def drop(self) -> None:
        """Delete the index's folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _read(self, tiers: int) -> DataFrame:
        return self.table.select("row", "doc_id", *(f"{c}_{t}" for t in range(tiers) for c in ("terms", "impacts")))

    def _first_k(self, hits: DataFrame, k: int) -> DataFrame:
        """The hits with their rank, up to k by item."""
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "row")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _partial(self, asked: Asked, tier: int, k: int) -> DataFrame:
        """Each task's k best partial scores by item, from the tiers up to `tier`."""
        shared = self.spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(shared.value.size, k)
            for part, doc_id, row in _chunks(batches, shared.value.size):
                best.add(shared.value.sums(*_flat(part, range(tier + 1)), part.num_rows), doc_id, row)
            yield best.batch()

        return in_arrow(self._read(tier + 1), run, HITS)

    def proofs(self, items: list[dict[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The tier at which each item is proven, and the floor of its k-th best score there (0 at the last tier)."""
        at, floor = np.full(len(items), self.tiers - 1), np.zeros(len(items), dtype=np.int64)
        open_ = np.array([bool(x) for x in items])
        for tier in range(self.tiers - 1):
            if not open_.any():
                break
            rest = self.rests(items, tier)
            # scores of the best by tier; the driver gets one number for each item
            found = self._first_k(self._partial(Asked.of(items, self.weights, open_), tier, k), k).where(F.col("rank") == k).select("item", "score").toPandas()
            reached = np.zeros(len(items), dtype=np.int64)
            reached[found["item"]] = found["score"]
            proven = open_ & (rest < reached)
            at[proven], floor[proven] = tier, reached[proven]
            open_ &= ~proven
        return at, floor

    def rests(self, items: list[dict[int, int]], tier: int) -> np.ndarray:
        """The most that a document can score that no posting up to `tier` names."""
        return np.array([sum(n * int(self.weights[t] * self.bound[tier, t]) for t, n in x.items()) for x in items], dtype=np.int64)

    def search(self, items: list[dict[int, int]], k: int) -> DataFrame:
        """item, row, doc_id, score, rank of the k best documents with a score above 0. items: times by number of a term."""
        at, floor = self.proofs(items, k)
        levels = [(t, Asked.of(items, self.weights, at == t), self.rests(items, t)) for t in range(self.tiers) if (at == t).any()]
        shared = self.spark.sparkContext.broadcast((levels, floor, self.bound))
        tiers = self.tiers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, floor, bound = shared.value
            best = Best(len(floor), k)
            for part, doc_id, row in _chunks(batches, len(floor)):
                for tier, asked, rest in levels:
                    doc, term, impact = _flat(part, range(tier + 1))
                    if tier == tiers - 1:
                        best.add(asked.sums(doc, term, impact, part.num_rows), doc_id, row)
                        continue
                    most = rest + asked.sums(doc, term, impact - bound[tier, term], part.num_rows)
                    hopeful = (most >= floor) & (most > rest)
                    some = np.flatnonzero(hopeful.any(axis=1))
                    if len(some):
                        full = asked.sums(*_flat(part.take(pa.array(some)), range(tiers)), len(some))
                        best.add(np.where(hopeful[some], full, 0), doc_id[some], row[some])
            yield best.batch()

        return self._first_k(in_arrow(self._read(tiers), run, HITS), k)


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """All different items that have a term, each with its terms' numbers of times, at most about `most` characters together."""
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // most)
    for k in range(parts):
        found = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        yield [(r["item_id"], c) for r in found if (c := counts_of(r["text"]))]


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, first: int = FIRST, growth: int = GROWTH, block: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item.

    Null texts and texts without a term are no documents, and such items have no row. Repeated rows of `docs` are
    documents of their own, equal scores go by doc_id, a null one first; items that are repeated as a whole are one, and
    different texts of one item_id each have their list. An empty table on either side gives no row. Extra columns are
    ignored. The corpus is indexed once for each `block` characters of items; the driver gets terms, their counts by steps of
    impact, and one score for each item, all bounded by the block.
    """
    spark, found = docs.sparkSession, []
    for own in blocks(items, block):
        terms = sorted({t for _, c in own for t in c})
        if not terms:
            continue
        index = TieredIndex(docs, terms, first, growth)
        named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(own)], "item int, item_id long")
        hits = index.search([{index.terms[t]: n for t, n in c.items()} for _, c in own], k)
        # k rows an item at most; written, so that the index need not outlive the search
        found.append(checkpointed(hits.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
        index.drop()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
WITH words AS (SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
               FROM (SELECT true AS document, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT false, item_id, NULL, text FROM benchmark) WHERE text IS NOT NULL),
     d AS (SELECT id, doc_id, len(w) AS n, w FROM words WHERE document AND len(w) > 0),
     s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM d),
     tf AS (SELECT id, doc_id, n, term, count(*) AS tf FROM (SELECT id, doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
     weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term),
     asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT id AS item_id, unnest(w) AS term FROM words WHERE NOT document) GROUP BY ALL),
     scores AS (SELECT item_id, id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))))::BIGINT AS score
                FROM asked JOIN weights USING (term) JOIN tf USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
