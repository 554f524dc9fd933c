import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, rows
from pyspark.sql import functions as F

from tickloom.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, least=2, most=3, count=10, share=50, top=2000):
    """The rows by plain counting. texts: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, most + 1):
                f.setdefault(lang or "und", Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) >= least and a >= count}
        found = []
        for p, a in held.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= share * a for q, b in held.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(df))


def prose(rng, n):
    words = ["Of", "the", "New", "york", "ñu", "a", "so", "x*"] + [f"w{k}" for k in range(12)]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("least, most, count, share, top", [(2, 3, 10, 50, 2000), (2, 5, 3, 30, 40), (3, 4, 2, 100, 7)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, most, count, share, top):
    rng = random.Random(most)
    texts = [(rng.choice(["en", "en", "fr", None]), prose(rng, rng.randint(0, 120))) for _ in range(60)] + [("en", "new york city is new york city ") for _ in range(15)] + [(None, None), ("fr", "")]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string").repartition(5)
    assert got(C.collocations(docs, least, most, count, share, top)) == brute(texts, least, most, count, share, top)


def test_the_query_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({C.SQL})").fetchall())
    assert want and got(C.collocations(spark.read.parquet(f"{folder}/documents.parquet"))) == want


def test_suffixes_are_sorted_with_their_common_prefixes():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 5, 7):
        ids = np.array([rng.randint(2, 4) for _ in range(200)], dtype=np.int32)
        starts = np.arange(len(ids) - n + 1)
        order, common = C.suffixes(ids, starts, n)
        texts = [tuple(ids[i : i + n]) for i in order]
        assert texts == sorted(texts)
        same = lambda a, b: next((k for k in range(n) if a[k] != b[k]), n)
        assert common.tolist() == [0] + [same(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        first, count = C.intervals(order, common, n)
        assert dict(zip((tuple(ids[i : i + n]) for i in first), count.tolist(), strict=True)) == Counter(tuple(ids[i : i + n]) for i in starts)


def test_small_shards_long_pieces_and_a_full_bitmap_change_nothing(monkeypatch):
    rng = random.Random(3)
    text = prose(rng, 3000).replace(".", " ").encode().translate(C.TABLE)
    whole = C.numbered([text])
    monkeypatch.setattr(C, "SHARD", 50)
    ids, words = C.numbered([text])
    assert [words[i] for i in ids] == [whole[1][i] for i in whole[0]]
    monkeypatch.setattr(C, "AT_ONCE", 64)
    for n in (1, 2, 3):
        counts = Counter()
        for starts, many in C.shard_counts(ids, n, np.full(1 << C.BITS - 3, 255, dtype=np.uint8), C.hashes("en", words)):
            for i, c in zip(starts, many.tolist(), strict=True):
                counts[b" ".join(words[j] for j in ids[i : i + n])] += c
        assert counts == Counter(b" ".join(p[i : i + n]) for p in (x.split() for x in text.split(b"\n")) for i in range(len(p) - n + 1))


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 123_456_789_012_345, 987_654_321_098_765, 223_456_789_012_346
    frequent = spark.createDataFrame([("en", "p", 1, left), ("en", "q", 1, right), ("en", "p q", 2, a)], "lang string, phrase string, size int, a long")
    assert rows(C.scored(frequent, 2, 50))[0]["score"] == 10**6 * a * a // (left * right)


def test_awkward_rows(spark):
    docs = awkward(spark).unionByName(awkward(spark)).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    texts = [(r["lang"], r["text"]) for r in docs.collect()]
    assert got(C.collocations(docs)) == brute(texts)
    assert C.collocations(documents(spark, [])).count() == 0
    assert C.collocations(documents(spark, [None, ""])).count() == 0
