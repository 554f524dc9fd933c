"""Near-duplicate documents by SimHash of their word shingles, checked and made whole by exact Jaccard similarity.

First come the fingerprints: sets whose 64-bit SimHash differs in at most 2 bits meet at the anchors of `simhash`, and
are linked if their Jaccard similarity is high enough. Similar sets may differ in more bits than anchors reach, so what
these links leave apart goes through an exact set join, which finds every similar pair.

Candidates of that join come from a prefix filter. The shingles of every set stand in one order; two sets of x <= y members
with similarity t or more have (x + y) t / (1 + t) members in common, so one of the first x - 2 t x / (1 + t) + 1
of the smaller is among the first y - t y + 1 of the larger. What stands behind the first shared one bounds
what can be in common, which rejects most other pairs. Any order gives the same result; shingles that a sample finds
common stand last, so the first ones meet few other sets. Next, parities of the members by bucket are compared:
where they differ, the sets differ, so too many differences reject a pair. What is left is checked on the whole sets.

Equal sets are one node. Only what joins two groups has to be checked: in each of a few rounds every node is
held against one candidate of another group, and shingles of more than `crowd` nodes are held against a pivot.
What of these is still apart after `rounds` becomes candidates pair by pair, and in the round `last` all candidates
that are left are checked, which is whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import simhash
from tickloom.llm.common import LOWER_ASCII, checkpointed, few, release
from tickloom.llm.components import components
from tickloom.ship import in_arrow

WIDTH = 5
SIMILAR = Fraction(4, 5)
SEED = 42
#: Keys up to this number are broadcast (16 bytes each); more are joined by a shuffle.
FEW = 500_000


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the runs of `width` words of a whole text (of all its words where there are fewer)."""
    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return np.unique(np.array([digest(join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))], dtype=np.uint64))


def node_of(held: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).view(np.int64))


def fingerprint(held: np.ndarray) -> int:
    """The 64-bit SimHash of a set, as a signed long; zero where it is empty."""
    counts = np.zeros(64, np.int64)
    raw = held.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 14):
        counts += np.unpackbits(raw[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(held), bitorder="little").view("<i8")[0])


def least(size: int, similar: Fraction) -> tuple[int, int]:
    """How many first members of a set meet those of any similar set: as the smaller of the two, and as either."""
    both = 2 * similar / (1 + similar)
    return size + int(-both * size // 1) + 1, size + int(-similar * size // 1) + 1


def prefix(held: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: Fraction = SIMILAR) -> np.ndarray:
    """The first members of a set in the order of (how common a sample finds them, hash)."""
    if not len(held):
        return held
    hashes, counts = common
    often = np.zeros(len(held), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, held), len(hashes) - 1)
        often = np.where(hashes[at] == held, counts[at], 0)
    return held[np.lexsort((held, often))[: least(len(held), similar)[1]]]


def parities(held: np.ndarray) -> bytes:
    """For each of 2 n to 4 n buckets of hashes, whether an odd number of the n members is in it, as bits.

    Half as many buckets have the exclusive or of the halves, so sets of different sizes can be compared.
    """
    buckets = 1 << max(6, int(len(held)).bit_length() + 1)
    odd = np.bincount((held & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(one: bytes, two: bytes) -> int:
    """Members that only one of the two sets has, at least, from their parities."""
    x, y = (np.frombuffer(b, np.uint64) for b in (one, two))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _text(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def common_shingles(docs: DataFrame, width: int = WIDTH, parts: int = 32, often: int = 8, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and counts, of about `most` shingles at most that `often` texts or more hold, of one in `parts` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if key not in seen:
                    seen.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), width).view(np.int64))], names=["shingle"])

    some = _text(docs).where(F.pmod("key", F.lit(parts)) == 0).select("key", "text")
    counts = checkpointed(in_arrow(some, run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= often))
    held, floor = 0, often
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        held += r["count"]
        if held > most:
            floor = r["n"] + 1
            break
    rows = counts.where(F.col("n") >= floor).toPandas().sort_values("shingle")
    hashes = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["n"].to_numpy(np.int64)[order]


def _signed(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], similar: Fraction, width: int) -> DataFrame:
    """doc_id, key (of the text), node, fp (SimHash), n (members), first (the set's prefix), odd (its parities) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column("text").cast(pa.binary())]
            firsts = [prefix(s, shared.value, similar) for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array([parities(s) for s in sets], pa.binary())], names=["doc_id", "key", "node", "fp", "n", "first", "odd"])

    return in_arrow(_text(docs).select("doc_id", "key", "text"), run, "doc_id long, key long, node long, fp long, n int, first array<long>, odd binary")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if key not in seen:
                    seen.add(key)
                    sets.append(shingles(text.as_py(), width))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "held"])

    return run


def _close(similar: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = similar.numerator, similar.denominator
        for batch in batches:
            sizes = batch.column("x").field("n").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("y").field("n").to_numpy(zero_copy_only=False)
            odd = (batch.column(c).field("odd") for c in "xy")
            keep = [differences(a.as_py(), b.as_py()) * (p + q) <= n * (q - p) for a, b, n in zip(*odd, sizes.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(similar: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * similar.denominator >= similar.numerator * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_prints(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash holds for near: every two nodes whose fingerprints differ in 2 bits or fewer
    are a pair, or are joined through others that are."""
    sets = signed.select("fp", "node").distinct()
    prints = checkpointed(sets.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    near = simhash.links(prints.select("fp", F.col("least").alias("node")), blocks=simhash.blocks_for(prints.count()))
    alike = sets.join(prints.where("n > 1").select("fp", "least"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = checkpointed(near.union(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(signed.sparkSession)
    return found


def _shared(sets: DataFrame, slices: int = 3) -> DataFrame:
    """sign, node, n, pos of the first members that several of the sets have, and of how many; slice by slice, so that less
    is on disk at once."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of_slice(k: int) -> DataFrame:
        members = sets.select("node", "n", F.posexplode("first").alias("pos", "sign")).where(F.pmod("sign", F.lit(slices)) == k).repartition(parts, "sign")
        met = members.groupBy("sign").agg(F.count("*").cast("int").alias("many")).where("many > 1")
        return checkpointed(members.join(met, "sign"))

    found = []
    for k in range(slices):
        found.append(of_slice(k))
        release(sets.sparkSession)
    return reduce(DataFrame.union, found).coalesce(parts)


def _may_be(x: str, y: str, similar: Fraction) -> Column:
    """Whether two sets that share the member at x.pos and y.pos, and none before, can be similar enough."""
    p, q = similar.numerator, similar.denominator
    nx, ny, px, py = (F.col(f"{side}.{c}").cast("long") for c in ("n", "pos") for side in (x, y))
    sized = (nx * q >= ny * p) & (ny * q >= nx * p)
    # the smaller has it among its first x - 2 t x / (1 + t) + 1; places count from 0
    early = lambda n, pos: pos * (p + q) <= n * (q - p)
    prefixed = ((nx <= ny) & early(nx, px)) | ((ny <= nx) & early(ny, py))
    left = F.least(nx - px, ny - py)
    return sized & prefixed & (left * (p + q) >= (nx + ny) * p)


def links(signed: DataFrame, docs: DataFrame, similar: Fraction = SIMILAR, width: int = WIDTH, crowd: int = 16, rounds: int = 2, last: int = 5) -> DataFrame:
    """Links (a, b) between nodes such that any two similar nodes are linked, at once or through others that are.

    Those that fingerprints lead to come first; the set join then checks only what they have left apart.
    """
    spark = docs.sparkSession
    near = near_prints(signed)
    # of rows with one set the first stands for all
    sets = checkpointed(signed.select("node", "key", "n", "first", "odd").dropDuplicates(["node"]))
    release(spark)
    shared = _shared(sets)

    def close(pairs: DataFrame, rows: int | None = None) -> DataFrame:
        """Those of the pairs (a, b), `rows` of them, whose sizes and parities allow that they are similar."""
        p, q = similar.numerator, similar.denominator
        tidy = (lambda df: df) if rows is None else lambda df: few(df, rows)
        x, y = (sets.select(F.col("node").alias(n), F.struct("n", "odd").alias(c)) for n, c in (("a", "x"), ("b", "y")))
        if rows is not None and rows <= FEW // 2:
            nodes = F.broadcast(checkpointed(tidy(tidy(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct())))
            x, y = (tidy(z.join(nodes.withColumnRenamed("node", n), n, "left_semi")) for z, n in ((x, "a"), (y, "b")))
        sized = F.expr(f"x.n * {q} >= y.n * {p} and y.n * {q} >= x.n * {p}")
        met = tidy(tidy(tidy(pairs).distinct()).join(x, "a")).join(y, "b").where(sized).select("a", "b", "x", "y")
        return checkpointed(in_arrow(tidy(met), _close(similar), "a long, b long"))

    def pairs(rows: DataFrame, apart: bool = False) -> DataFrame:
        one, two = (rows.select("sign", F.struct("node", "n", "pos", *(["top"] if apart else [])).alias(x)) for x in ("x", "y"))
        met = one.join(two, "sign").where("x.node < y.node").where(_may_be("x", "y", similar))
        return (met.where("x.top <> y.top") if apart else met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    todo = close(pairs(shared.where(F.col("many") <= crowd)))
    left = todo.count()
    todo = few(todo, left)
    crowded = shared.where(F.col("many") > crowd).select("sign", "node", "n", "pos")
    many = crowded.count()
    apart = checkpointed(few(crowded, many))
    release(spark)

    def checked(pairs: DataFrame, rows: int, slices: int = 3) -> DataFrame:
        """The pairs, `rows` of them, that are similar; only the texts of their nodes are read and only a slice's sets are on disk at once."""
        nodes = checkpointed(few(few(pairs, rows).select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows))
        asked = nodes.count()
        keys = checkpointed(few(sets.select("node", "key").join(F.broadcast(nodes) if asked <= FEW else nodes, "node", "left_semi").select("key"), asked))
        texts = _text(docs).join(F.broadcast(keys) if asked <= FEW else keys, "key", "left_semi").select("key", "text")
        held = checkpointed(few(in_arrow(texts, _sets(width), "node long, held binary").dropDuplicates(["node"]), 4 * asked))
        slices = min(slices, 1 + rows // 20_000)
        found = []
        for k in range(slices):
            one, two = (held.select(F.col("node").alias(n), F.col("held").alias(h)) for n, h in (("a", "one"), ("b", "two")))
            some = few(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k), rows)
            met = few(few(some.join(one, "a"), 4 * rows).join(two, "b").select("a", "b", "one", "two"), 4 * rows)
            found.append(checkpointed(in_arrow(met, _similar(similar), "a long, b long")))
            release(spark)
        return few(reduce(DataFrame.union, found), rows)

    near = close(near, near.count())
    found = checked(near, near.count())
    for k in range(last + 1):
        tops = components(found, tidy=True)
        for n in ("a", "b"):
            todo = few(todo.join(tops.select(F.col("node").alias(n), F.col("component").alias(f"t{n}")), n, "left"), left).withColumn(f"t{n}", F.coalesce(f"t{n}", n))
        todo = checkpointed(todo.where("ta <> tb").select("a", "b"))
        left = todo.count()
        todo = few(todo, left)
        named = checkpointed(few(apart.join(tops, "node", "left").withColumn("top", F.coalesce("component", "node")).drop("component"), many))
        split = few(named.groupBy("sign").agg(F.min("top").alias("low"), F.max("top").alias("high"), F.min_by(F.struct("node", "top"), F.xxhash64("node", F.lit(k))).alias("pivot")).where("low <> high").select("sign", "pivot"), many)
        named = checkpointed(few(named.join(split, "sign"), many))
        many = named.count()
        named = few(named, many)
        if not many and not left:
            break
        if k < rounds:
            star = close(named.where(F.col("top") != F.col("pivot.top")).select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")), many)
        else:
            # what pivots have not joined is held against each other, once for all
            todo = checkpointed(todo.union(close(pairs(named, apart=True))).distinct())
            left, many = todo.count(), 0
            todo = few(todo, left)
            star, named = todo.limit(0), named.limit(0)
        some = todo if k == last else few(todo.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(star), left + many).distinct()
        some = checkpointed(few(some, left + many))
        todo = few(todo.join(some, ["a", "b"], "left_anti"), left)
        found = few(found.union(checked(some, some.count())), found.count() + left + many)
        apart = named.select("sign", "node", "n", "pos")
    return found


def groups(docs: DataFrame, similar: Fraction = SIMILAR, width: int = WIDTH) -> DataFrame:
    """doc_id, node, top for every row of `docs`: the set of its shingles, and the group of sets it is in."""
    signed = checkpointed(_signed(docs, common_shingles(docs, width), similar, width))
    tops = components(links(signed, docs, similar, width), tidy=True)
    return signed.select("doc_id", "node").join(tops, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("top"))


def keep_one(docs: DataFrame, similar: Fraction = SIMILAR, width: int = WIDTH) -> DataFrame:
    """The rows of `docs`, all columns, one of each group: that with the smallest doc_id.

    Where rows with different texts share that doc_id, the others of the group are still dropped, and rows of
    other groups with the same doc_id stay. A row without a doc_id is kept only where its group has none with one.
    """
    found = checkpointed(groups(docs, similar, width))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "node")).alias("best")
    kept = checkpointed(found.groupBy("top").agg(best).select("best.doc_id", "best.node"))
    often = checkpointed(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    # whole rows go along as one column, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    single = rows.join(kept.join(often, "doc_id", "left_anti").where("doc_id is not null").select(F.col("doc_id").alias("kept")), F.col("id") == F.col("kept"), "left_semi").select("row.*")
    if often.isEmpty():
        return single
    # repeated ids are rare enough to be dealt with apart: their texts say which row is meant
    ids = often.select(F.col("doc_id").alias("often"))
    repeated = rows.join(F.broadcast(ids) if often.count() < 10_000 else ids, F.col("id").eqNullSafe(F.col("often")), "left_semi")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = row.field(row.type.get_field_index("text")).cast(pa.binary())
            yield batch.append_column("node", pa.array([node_of(shingles(t.as_py(), width)) for t in texts], pa.int64()))

    tagged = in_arrow(repeated, tag, T.StructType([*repeated.schema.fields, T.StructField("node", T.LongType())]))
    chosen = kept.select(F.col("doc_id").alias("kept"), F.col("node").alias("at"))
    meant = tagged.join(chosen, F.col("id").eqNullSafe(F.col("kept")) & (F.col("node") == F.col("at")), "left_semi")
    return single.unionByName(meant.dropDuplicates(["id", "node"]).select("row.*"))
