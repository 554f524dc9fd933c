import random

import corpus_pipeline
import numpy as np
from helpers import awkward, documents

from tickloom.llm import jaccard


def brute(texts):
    """For each text the first one that links of Jaccard similarity 0.8 or more reach."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    top = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = [new if t == old else t for t in top]
    return top


def edited(rng, words, edits):
    made = list(words)
    for _ in range(edits):
        made[rng.randrange(len(made))] = f"x{rng.randrange(9999)}"
    return " ".join(made[rng.randrange(3) :])


def corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    for n in (6, 9, 14, 30, 60, 120, 400):
        for _ in range(3):
            words = [f"w{rng.randrange(500)}" for _ in range(n)]
            texts += [" ".join(words), *(edited(rng, words, rng.randrange(1 + n // 20)) for _ in range(5))]
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    return texts + [edited(rng, base, rng.randrange(6)) for _ in range(60)]


def test_similar_sets_share_one_of_their_first_members():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, 1 + n // 6)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
        hashes = np.unique(rng.choice(x, size=min(3, n)))
        common = (hashes, rng.integers(1, 9, len(hashes)))
        both = len(np.intersect1d(x, y))
        if both * 5 >= 4 * (len(x) + len(y) - both):
            small, large = sorted((x, y), key=len)
            first = jaccard.prefix(small, common)[: jaccard.least(len(small), jaccard.SIMILAR)[0]]
            assert set(first.tolist()) & set(jaccard.prefix(large, common).tolist())
        assert jaccard.differences(jaccard.parities(x), jaccard.parities(y)) <= len(x) + len(y) - 2 * both


def test_stage_keeps_one_of_each_group_of_brute_force_jaccard(spark):
    texts = corpus()
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    got = sorted(r["doc_id"] for r in stage(spark, documents(spark, texts), "").collect())
    assert got == sorted(set(brute(texts)))


def test_repeated_and_missing_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    docs = documents(spark, [(5, one), (5, two), (2, two), (2, two), (None, one + " end"), (None, three), (None, three)])
    got = sorted((r["doc_id"] or -1, r["text"]) for r in jaccard.keep_one(docs).collect())
    assert got == [(-1, three), (2, two), (5, one)]
    assert jaccard.keep_one(awkward(spark)).count() == 7


def test_columns_of_any_name_go_along(spark):
    from pyspark.sql import functions as F

    from tickloom.llm import simhash

    names = ["_kept", "_id", "_node", "_often", "_at", "_print", "_of", "row", "id", "kept", "node", "often", "at", "print", "of"]
    docs = awkward(spark).withColumns({n: F.lit(f"{n} clash") for n in names})
    for keep_one in (jaccard.keep_one, simhash.keep_one):
        got = keep_one(docs)
        assert got.columns == docs.columns
        want = keep_one(awkward(spark))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert {r["_id"] for r in got.collect()} == {"_id clash"}


def test_groups_come_through_fingerprints_and_checked_pairs(spark, monkeypatch):
    from tickloom.llm import simhash

    texts, seen, links = corpus(), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, **more: seen.append({r["node"]: r["fp"] for r in prints.collect()}) or links(prints, **more))
    docs = documents(spark, texts)
    signed = jaccard.checkpointed(jaccard._signed(docs, jaccard.common_shingles(docs), jaccard.SIMILAR, jaccard.WIDTH))
    pairs = {(r["a"], r["b"]) for r in jaccard.near_prints(signed).collect()}
    prints = {r["node"]: r["fp"] for r in signed.collect()}
    sets = [jaccard.shingles(t.encode()) for t in texts]
    for s in sets:
        bits = [sum(int(h) >> b & 1 for h in s) * 2 > len(s) for b in range(64)]
        assert prints[jaccard.node_of(s)] % (1 << 64) == sum(1 << b for b, on in enumerate(bits) if on)
    near = {(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 2}
    assert near and pairs <= near and {x for p in pairs for x in p} == {x for p in near for x in p}
    assert jaccard.keep_one(docs).count() == len(set(brute(texts))) and len(seen) == 2


def test_components_of_a_small_graph_take_few_tasks(spark):
    from tickloom.llm.components import components

    many = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in many}
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        context.setJobGroup("small graph", "")
        got = {(r["node"], r["component"]) for r in components(edges, tidy=True).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("small graph") for s in tracker.getJobInfo(j).stageIds}
    assert got == {(k, 0) for k in range(41)}
    assert sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 1000
