import random

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, rows

from tickloom.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, threshold=2):
    name = dict(zip(ids, ids, strict=True))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= threshold:
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {i: top(i) for i in ids}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in ("The quick brown fox", "one", "two words", "A b\tC d\nE", None, "", "Éa éA x y"):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("blocks", [2, 3])
def test_every_word_has_one_home_and_close_words_meet(blocks):
    random.seed(5)
    words = np.array([random.getrandbits(63) for _ in range(40)], dtype=np.int64)
    row, anchor, home = simhash.anchors(words, blocks=blocks)
    assert np.bincount(row[home], minlength=40).tolist() == [1] * 40
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    for k, w in enumerate(words.tolist()):
        near = w
        for bit in random.sample(range(63), 2):
            near ^= 1 << bit
        _, reached, _ = simhash.anchors(np.array([near], dtype=np.int64), blocks=blocks)
        assert homes[k] in reached.tolist()


def test_third_block_makes_more_anchors():
    words = np.arange(64, dtype=np.int64) << 46
    few, many = (set(simhash.anchors(words, blocks=b)[1][simhash.anchors(words, blocks=b)[2]].tolist()) for b in (2, 3))
    assert len(few) == 1 and len(many) > 1
    assert (simhash.blocks_for(1 << 26), simhash.blocks_for((1 << 26) + 1)) == (2, 3)


@pytest.mark.parametrize("blocks", [2, 3])
def test_links_find_all_pairs_in_quiet_and_crowded_anchors(spark, blocks):
    random.seed(11)
    centre = random.getrandbits(63)
    crowd = {centre ^ sum(1 << b for b in random.sample(range(63), random.randint(0, 3))) for _ in range(120)}
    quiet = {random.getrandbits(63) for _ in range(60)}
    quiet |= {q ^ 5 for q in list(quiet)[:20]} | {q ^ (1 << 63) - (1 << 62) for q in list(quiet)[:5]}
    ids = list(range(len(crowd | quiet)))
    prints = dict(zip(ids, sorted(crowd | quiet), strict=True))
    frame = spark.createDataFrame([(p, i) for i, p in prints.items()], "fp long, node long")
    from tickloom.llm.components import components

    found = {r["node"]: r["component"] for r in components(simhash.links(frame, blocks=blocks)).collect()}
    want = brute_components(prints, ids)
    assert {i: found.get(i, i) for i in ids} == want


def test_near_duplicates_of_awkward_rows(spark):
    got = rows(simhash.near_duplicates(awkward(spark)))
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert by[None]["component_id"] is None and by[4]["component_id"] == 4
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_keep_one_of_each_group(spark):
    text = "some words that stand here once and are copied after that by others " * 3
    docs = documents(spark, [(9, text), (3, text), (3, text), (5, "quite another text with its own words in it"), (None, text), (None, "alone without an id"), (None, "alone without an id")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"][:5]) for r in kept.collect()) == [(-1, "alone"), (3, "some "), (5, "quite")]


def test_keep_one_tells_texts_with_one_id_apart(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = documents(spark, [(5, one), (5, two), (2, two), (2, two), (None, one), (None, "three words here"), (None, "three words here")])
    assert sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(docs).collect()) == [(-1, "three words here"), (2, two), (5, one)]


def test_hub_with_most_links_is_one_component(spark):
    from tickloom.llm.components import components

    edges = spark.createDataFrame([(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert len(got) == 3041 and all(c == (0 if n < 5000 else 5000) for n, c in got.items())
