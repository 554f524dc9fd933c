"""Phrases whose words stand together more often than their parts would have it.

Texts are cut into pieces at punctuation and pieces into words. A task gathers texts into shards, numbers the words
of a shard and sorts its positions by prefix doubling: ranks of h words give ranks of 2h, until n words are told apart.
Neighbours in that order have a longest common prefix, and a run of prefixes of n words or more is an n-gram with
its count in the shard. Counts are merged by language and phrase.

Lengths are counted one after another: an n-gram can be frequent only if both its (n - 1)-grams are, and those stand
in a bitmap of a fixed number of bits that goes to every task. A bit too many costs a row that is dropped at the
merge, so the counts are exact at any size. Ranks come from a sort by ranges, so no language is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, join_by_key, slices
from tickloom.ship import in_arrow

#: A-Z to a-z, the ends of pieces to a line feed, tab to space.
TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
#: Bytes of text in a shard, and words sorted at once.
SHARD, AT_ONCE = 6_000_000, 1 << 20
#: Bits of the bitmap: 2 ** 27, 16 MB.
BITS = 27
#: Numbers of the empty string and of the end of a piece.
NOTHING, END = 0, 1


class Numbers(dict):
    """Numbers of words, given as they come."""

    def __init__(self) -> None:
        super().__init__({b"": NOTHING, b"\n": END})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The word numbers of translated texts, an END after each piece, and the words by number."""
    known = Numbers()
    parts = [np.array([END], dtype=np.int32)]
    for text in texts:
        for part in slices(text, SHARD):
            ids = np.fromiter(map(known.__getitem__, part.replace(b"\n", b" \n ").split(b" ")), dtype=np.int32)
            parts.append(ids[ids != NOTHING])
        parts.append(parts[0])
    return np.concatenate(parts), list(known)


def suffixes(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the n words from there on, and the words that each has in common with the one before (n at most).

    Prefix doubling: places are ranked by their first word, then by two, by four and so on; n words are told apart by the
    ranks of their first and last h, of which 2h cover them.
    """
    rank, h = ids.astype(np.int64), 1
    while 2 * h <= n:
        pair = rank[:-h] * (rank.max() + 1) + rank[h:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        h *= 2
    order = starts[np.argsort(rank[starts] * (rank.max(initial=0) + 1) + rank[starts + n - h], kind="stable")]
    common, alike = np.zeros(len(order), dtype=np.int64), np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in range(n):
        alike &= ids[order[1:] + k] == ids[order[:-1] + k]
        common[1:] += alike
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One start of each interval of prefixes of n words, and the interval's length."""
    heads = np.flatnonzero(common < n)
    return order[heads], np.diff(np.append(heads, len(order)))


def mixed(words: np.ndarray, ids: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Cells of the bitmap for the n words from each start on; `words` has the hash of each number."""
    h = np.zeros(len(starts), dtype=np.uint64)
    for k in range(n):
        h = (h ^ words[ids[starts + k]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, some `SHARD` bytes together at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            data = (text.as_py() or "").encode().translate(TABLE)
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= SHARD:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def shard_counts(ids: np.ndarray, n: int, known: np.ndarray | None, words: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A start and the count of each n-gram within the pieces of a shard whose (n - 1)-grams all have their bit in `known`."""
    for at in range(0, len(ids), AT_ONCE):
        part = ids[at : at + AT_ONCE + n - 1]
        starts = np.arange(max(0, min(AT_ONCE, len(part) - n + 1)))
        whole = np.ones(len(starts), dtype=bool)
        for k in range(n):
            whole &= part[starts + k] != END
        starts = starts[whole]
        if known is not None:
            for k in (0, 1):
                cells = mixed(words, part, n - 1, starts + k)
                starts = starts[known[cells >> 3] >> (cells & 7) & 1 > 0]
        if len(starts):
            first, count = intervals(*suffixes(part, starts, n), n)
            yield at + first, count


def counted(docs: DataFrame, n: int, known: np.ndarray | None) -> DataFrame:
    """lang, phrase, a: counts of n-grams, merged over all shards. For n = 1 a null phrase has the count of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches):
            ids, words = numbered(texts)
            hashed = hashes(lang, words) if n > 1 else None
            if n == 1:
                yield pa.RecordBatch.from_pydict({"lang": [lang], "phrase": pa.array([None], pa.string()), "a": [int((ids != END).sum())]})
            table = pa.array(words, pa.binary())
            for starts, count in shard_counts(ids, n, shared.value, hashed):
                for k in range(0, len(starts), 100_000):
                    some = starts[k : k + 100_000]
                    columns = [table.take(pa.array(ids[some + j])) for j in range(n)]
                    phrase = columns[0] if n == 1 else pa.compute.binary_join_element_wise(*columns, b" ")
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "phrase": phrase.cast(pa.string()), "a": pa.array(count[k : k + 100_000])})

    return in_arrow(docs, run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """The bits of all phrases of n words in `frequent`; the driver gets at most 2 ** BITS of them, 64 in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.zeros(0, dtype=np.int64)]
            by: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                by.setdefault(lang, []).extend(phrase.encode().split(b" "))
            for lang, words in by.items():
                cells.append(mixed(hashes(lang, words), np.arange(len(words)), n, np.arange(0, len(words), n)))
            at = np.concatenate(cells)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).astype(np.int64))], names=["word", "bits"])

    rows = in_arrow(frequent.select("lang", "phrase"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, dtype="<i8")
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, most: int, count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of up to `most` words that come `count` times or more, and (lang, n), the words of each language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = checkpointed(counted(rows, 1, None).where((F.col("a") >= count) | F.col("phrase").isNull()))
    levels = [words.where("phrase is not null")]
    for n in range(2, most + 1):
        levels.append(checkpointed(counted(rows, n, bitmap(levels[-1], n - 1)).where(F.col("a") >= count)))
    return reduce(DataFrame.union, (level.select("lang", "phrase", F.lit(n).alias("size"), "a") for n, level in enumerate(levels, 1))), words.where("phrase is null").select("lang", F.col("a").alias("n"))


def _with_counts(rows: DataFrame, part: str, counts: DataFrame, out: str, total: int) -> DataFrame:
    """The rows with the count `out` of their phrase `part`; a part that many rows have is joined by broadcast."""
    rows = rows.withColumn("key", F.struct("lang", F.col(part).alias("phrase")))
    uses = rows.groupBy("key").agg(F.count("*").alias("uses"))
    one = uses.join(counts.select(F.struct("lang", "phrase").alias("key"), F.col("a").alias(out)), "key")
    return join_by_key(rows, one, "key", "uses", total).drop("key")


def _parts(name: str, least: int) -> F.Column:
    """All runs of `least` words or more of the phrase that are shorter than itself."""
    return F.expr(f"flatten(transform(sequence({least}, size({name}) - 1), m -> transform(sequence(1, size({name}) - m + 1), k -> array_join(slice({name}, k, m), ' '))))")


def scored(frequent: DataFrame, least: int, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that are left beside longer ones."""
    words = F.split("phrase", " ")
    candidates = frequent.where(F.col("size") >= least).withColumn("words", words)
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words")
    cuts = checkpointed(cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("rest")))
    total = cuts.count()
    both = _with_counts(_with_counts(cuts, "first", frequent, "l", total), "rest", frequent, "r", total)
    exact = "cast(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)"
    lowest = both.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    longer = candidates.where(F.col("size") > least).select("lang", F.explode(_parts("words", least)).alias("phrase"), F.col("a").alias("longer"))
    within = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(rows: DataFrame, by: str, order: list[F.Column], top: int) -> DataFrame:
    """The first `top` rows of each value of `by`, with their `rank`, from a sort by ranges over all rows."""
    keys = [F.col(by).asc(), *order]
    placed = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    groups = placed.groupBy("_part", by).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.withColumn("_before", F.coalesce(earlier, F.lit(0))).where(F.col("_before") < top).drop("_rows")
    return placed.join(starts, ["_part", by]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).where(F.col("rank") <= top).drop("_at", "_part", "_first", "_before")


def collocations(docs: DataFrame, least: int = 2, most: int = 3, count: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of `least` to `most` words with the highest scores in each language.

    a, l, r count the phrase and the two parts of its lowest-scoring cut, n all words of the language; the score is
    a million a a / (l r), rounded down. A phrase goes where a longer candidate holds it `share` hundredths of its times.
    Null and empty texts have no words; a null lang is `und`, an empty one stays itself; repeated rows count each; equal
    scores go by a, then by phrase. A language without a phrase, and an empty table, have no row. Extra columns are ignored.
    """
    frequent, totals = frequent_phrases(docs, most, count)
    found = ranked(scored(frequent, least, share), "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    # few rows are left by now: at most `top` for each row of totals
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
     lists AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
     grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
               FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (VALUES (1), (2), (3)) AS sizes(m))),
     f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
     totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
     candidates AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
     cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM candidates c, (VALUES (1), (2)) AS ks(k) WHERE k < m),
     judged AS (SELECT c.lang, c.m, c.phrase, c.a, k, x.a AS l, y.a AS r, 1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS score
              FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
     lowest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE m = 3) GROUP BY ALL),
     kept AS (SELECT b.* FROM lowest b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""
