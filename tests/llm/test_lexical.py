import math
import random
import re
from collections import Counter

import duckdb
import pytest
from helpers import awkward, documents, rows

from tickloom.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document. docs: (doc_id, text); items: (item_id, text)."""
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, size in held:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, -1 if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(df)), key=str)


def prose(rng, n):
    return " ".join(rng.choice(["The", "of", "und", "ñandú", "x-9", "Ärger", f"w{int(rng.paretovariate(0.6)) % 400}"]) for _ in range(n))


@pytest.fixture(scope="module")
def some():
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randint(0, 90))) for i in range(400)]
    docs += docs[:40] + [(500 + i, docs[3][1]) for i in range(30)] + [(None, docs[5][1]), (900, None), (901, "--- !!"), (902, "the of " * 3000)]
    items = [(i, " ".join(docs[i * 7][1].split()[:25]) or "the") for i in range(30)] + [(40, "the of und"), (41, None), (42, "?!"), (43, "absent words"), (44, "w1 w1 w1 w2"), (44, "w1 w1 w1 w2"), (44, "w3")]
    return docs, items


@pytest.mark.parametrize("first, growth, block", [(5, 3, 4_000_000), (40, 2, 300), (1000, 32, 4_000_000)])
def test_search_equals_scoring_every_document(spark, some, first, growth, block):
    docs, items = some
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.ranked(table, asked, first=first, growth=growth, block=block)) == brute(docs, items)


def test_some_items_are_proven_early_and_others_fall_through(spark, some):
    docs, items = some
    own = [lexical.counts_of(t) for _, t in items if lexical.counts_of(t)]
    index = lexical.TieredIndex(spark.createDataFrame(docs, "doc_id long, text string"), sorted({t for c in own for t in c}), 30, 3)
    at, floor = index.proofs([{index.terms[t]: n for t, n in c.items()} for c in own], 5)
    assert index.tiers > 2 and len(set(at.tolist())) > 1 and at.min() < index.tiers - 1
    assert (floor[at < index.tiers - 1] > 0).all()
    assert "impacts_1" not in index._read(1).columns
    path = spark._jvm.org.apache.hadoop.fs.Path(index.folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    index.drop()
    assert not files.exists(path)


def test_terms_in_slices(monkeypatch):
    text = "Aé_b c--ÀB 9x" * 50
    monkeypatch.setattr(lexical, "AT_ONCE", 7)
    assert lexical.counts_of(text) == Counter(t.encode() for t in terms(text))


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.SQL})").fetchall(), key=str)
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    assert want and got(lexical.ranked(read("documents"), read("benchmark"))) == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "one"), (2, None), (3, "lange wörter"), (None, "some words"), (4, "é")], "item_id long, text string")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(lexical.ranked(docs, items)) == brute(pairs, [tuple(r) for r in items.collect()])
    assert lexical.ranked(documents(spark, []), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
