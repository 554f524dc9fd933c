import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import awkward, documents, rows
from tokenizers import Tokenizer

from tickloom.llm import decontam, gru_lm, langid, packing, token_rollup
from tickloom.llm.tokens import Vocabulary, encoder


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizers_library(exact):
    encode = encoder(Vocabulary.load()).encode
    for text in ("", "plain words", "  wide   gaps \n\n and\ttabs ", "don't <|endoftext|> stop", "éß中\U0001f600 12,5%", " ", "\n \n"):
        assert np.frombuffer(encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    for model in (None, langid.train(docs)):
        got = {r["doc_id"]: r for r in rows(langid.identify(docs, model))}
        assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
        assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(documents(spark, [])) is None


def test_presence_is_the_set_of_grams():
    text = "Abé, AB"
    clean = " abé ab "
    assert len(langid.presence(text)) == sum(len({clean[i : i + n] for i in range(len(clean) - n + 1)}) for n in (1, 2, 3))


def test_language_model_equals_brute_force():
    import random

    random.seed(3)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "the cat sat on that mat".split()}
    texts = [(lang, " ".join(random.choice(words[lang]) for _ in range(random.randint(3, 12)))) for lang in ("aa", "bb") * 9]
    model = langid.fit([lang for lang, _ in texts], [langid.presence(t) for _, t in texts], landmarks=5)

    def grams(text):
        padded = f" {text} "
        return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    held = [grams(t) for _, t in texts]
    marks = []
    for lang in ("aa", "bb"):
        own = [i for i, (x, _) in enumerate(texts) if x == lang]
        marks += sorted(own, key=lambda i: (-min(len(held[i]), 100), i))[:5]
    cross = np.array([[kernel(a, held[m]) for m in marks] for a in held])
    assert np.allclose(model.kernel([langid.presence(t) for _, t in texts]), cross, atol=1e-6)
    # one ridge regression against the rest, in the space that the landmarks span
    values, vectors = np.linalg.eigh(np.array([[kernel(held[a], held[b]) for b in marks] for a in marks]))
    use = values > 1e-6 * values[-1]
    x = cross @ (vectors[:, use] / np.sqrt(values[use]))
    for k, lang in enumerate(("aa", "bb")):
        y = np.array([1.0 if of == lang else -1.0 for of, _ in texts])
        flat = np.hstack([x, np.ones((len(x), 1))])
        loss = np.diag([1e-2 * len(x) * 0.1] * x.shape[1] + [0.0])
        w = np.linalg.solve(flat.T @ flat + loss, flat.T @ y)
        assert np.allclose(flat @ w, cross @ model.weights[:, k] + model.bias[k], atol=1e-4)


def test_letters_are_those_of_category_l():
    import unicodedata

    for text in ("² ½ x²", "Ⅷ ٣", "naïve Straße", "日本語 と ひ", "a_b1c"):
        want = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text).split()
        assert langid.WORD.findall(text) == want


def test_base_scores_equal_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in gru_lm.score(docs, hidden=4, classes=4, coverage=0.2, least=1, rounds=1).collect()}
    train = ",".join(str(r["doc_id"]) for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""WITH t AS (SELECT doc_id, unnest(list_append(list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), '')) AS word FROM '{path}'),
    c AS (SELECT word, count(*) AS n FROM t WHERE doc_id IN ({train}) GROUP BY word), s AS (SELECT sum(n) AS tokens, count(*) AS v FROM c)
    SELECT doc_id, count(*) AS n_tokens, count(n) AS n_known, sum(log10((coalesce(n, 0) + 0.1) / (tokens + 0.1 * (v + 1)))) AS base FROM t LEFT JOIN c USING (word), s GROUP BY doc_id"""
    for doc_id, n_tokens, n_known, base in duckdb.sql(sql).fetchall():
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"]) == (n_tokens, n_known) and math.isclose(r["base_score"], base, rel_tol=1e-9)


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "a"))
    assert rollup.totals().count() == 0
    make = lambda *x: spark.createDataFrame([("s", None, "t", "1", *y) for y in x], "source string, lang string, tokenizer string, version string, op string, n_tokens long, old_tokens long")
    assert rollup.commit("one", make(("insert", 10, None), ("insert", 5, None)))
    assert [rollup.commit("two", make(("delete", 5, None), ("revise", 12, 10))) for _ in range(2)] == [True, False]
    assert rows(rollup.totals()) == [{"source": "s", "lang": None, "tokenizer": "t", "version": "1", "n_docs": 1, "n_tokens": 12}]
    folded = rollup.compact(str(tmp_path / "b"))
    assert not folded.commit("two", make(("insert", 99, None)))
    for name in ("base", "folded"):  # no name of a batch meets one of the ledger's own
        assert folded.commit(name, make(("insert", 3, None)))
    assert folded.totals().first()["n_tokens"] == 18
    folded.commit("three", make(("delete", 12, None), ("delete", 3, None), ("delete", 3, None)))
    assert folded.totals().count() == 0
    again = folded.compact(str(tmp_path / "c"))
    assert all(again.committed(x) for x in ("base", "folded", "one", "two", "three")) and not again.committed("four")
    for bad in (("drop", 1, None), ("insert", None, None), ("revise", 1, None)):
        with pytest.raises(Exception):  # noqa: B017
            rollup.commit("bad", make(bad))
    assert rollup.totals().first()["n_tokens"] == 12  # what failed left nothing that counts


def test_a_run_without_pointer_does_not_count(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "a"))
    one = spark.createDataFrame([("s", "en", "t", "1", "insert", 10, None)], "source string, lang string, tokenizer string, version string, op string, n_tokens long, old_tokens long")
    rollup.commit("one", one)
    rollup._write(spark.createDataFrame([("s", "en", "t", "1", 1, 7)], "source string, lang string, tokenizer string, version string, n_docs long, n_tokens long"))
    assert rollup.totals().first()["n_tokens"] == 10


def test_rollup_query_equals_sums(spark, exact):
    from tickloom.llm.queries import op3_token_counts

    sf_dir, want = "/root/testdata/sf0.001", Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for name, n in (("words", len((r["text"] or "").encode().split())), ("byte_bpe_50k", len(exact.encode(r["text"] or "", add_special_tokens=False).ids))):
            want[r["source"], r["lang"], name, "n_docs"] += 1
            want[r["source"], r["lang"], name, "n_tokens"] += n
    got = {(r["source"], r["lang"], r["tokenizer"], c): r[c] for r in op3_token_counts(spark, sf_dir).collect() for c in ("n_docs", "n_tokens")}
    assert got == dict(want)


def test_word_counts_equal_sql(spark):
    import duckdb

    from tickloom.llm.queries import op3_token_counts

    sf_dir = "/root/testdata/sf0.001"
    sql = f"""SELECT source, lang, count(*) AS n_docs, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS n_tokens
              FROM '{sf_dir}/documents.parquet' GROUP BY source, lang"""
    got = op3_token_counts(spark, sf_dir).where("tokenizer = 'words'").select("source", "lang", "n_docs", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((a, b, c, int(d)) for a, b, c, d in duckdb.sql(sql).fetchall()), key=str)


def test_token_counts_match_the_library(spark, exact):
    docs = awkward(spark).where("doc_id < 7")
    got = {(r["doc_id"], r["tokenizer"]): r["n_tokens"] for r in rows(token_rollup.token_counts(docs))}
    for r in rows(docs):
        assert got[r["doc_id"], "byte_bpe_50k"] == len(exact.encode(r["text"] or "", add_special_tokens=False).ids)
        assert got[r["doc_id"], "words"] == len((r["text"] or "").split())


def test_plan_places_everything_near_the_bound():
    rng = np.random.default_rng(4)
    counts = Counter(rng.integers(1, 2049, 4000).tolist()) + Counter(rng.geometric(0.01, 6000).clip(1, 2048).tolist())
    of_program, rest = packing.round_up(counts)
    plan = of_program + rest
    # sequences that the program gives, leaving out single full pieces
    own = sum(k for config, k in of_program if config[0][0] < 2048)
    assert own >= 0.4 * (own + sum(k for _, k in rest))
    placed = Counter()
    for config, k in plan:
        assert sum(n * a for n, a in config) <= 2048
        for n, a in config:
            placed[n] += a * k
    assert placed == counts
    assert sum(k for _, k in plan) <= 1.01 * math.ceil(sum(n * c for n, c in counts.items()) / 2048) + 1


def test_packed_pieces_are_the_documents(spark, exact):
    docs = documents(spark, [(0, None), (1, ""), (2, "word " * 5000), (3, "some text"), (3, "some text"), (None, "x y z")])
    got = rows(packing.pack(docs))
    assert packing.pack(documents(spark, [])).count() == 0
    ids = exact.encode("word " * 5000, add_special_tokens=False).ids + [0]
    whole = sorted((r for r in got if r["doc_id"] == 2), key=lambda r: r["piece"])
    assert [r["piece"] for r in whole] == list(range(len(whole))) and whole[0]["length"] <= 2048
    for r in whole:
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r["length"]
    assert sum(r["length"] for r in whole) == len(ids)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(got) == 5 + len(whole)


def brute_edits(window, text):
    row = [0] * (len(text) + 1)
    for a in window:
        new = [row[0] + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (a != c), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force():
    import random

    random.seed(8)
    item = "the q gram lemma bounds how many shared pieces two strings must have when few edits part them, so counting is a filter that never loses a match at all"
    index = decontam.Index.of([(7, item)])
    hits = 0
    for _ in range(120):
        letters = list(item)
        for _ in range(random.randint(0, 16)):
            at = random.randrange(len(letters))
            letters[at : at + random.randint(0, 1)] = random.choice(["", "x", "zz"])
        text = "other words before it " + "".join(letters).upper().replace(" ", "  ") + " and words after"
        plain = "".join(map(chr, decontam.normalise(text)[0]))
        want = any(brute_edits("".join(map(chr, w.points)), plain) <= w.edits for w in index.windows)
        assert bool(decontam.leaks(text, index)) == want
        hits += want
    assert 20 < hits < 120


def test_leak_spans_and_filter(spark):
    passage = "A passage of the benchmark that is long enough to be evidence wherever it may stand in a text."
    docs = documents(spark, [(1, f"before {passage} after"), (2, "clean text " * 50), (3, None), (4, ""), (5, passage), (5, passage), (6, "z" * 100_000)])
    bench = spark.createDataFrame([(1, passage), (2, "too short"), (None, passage), (3, None)], "item_id long, text string")
    got = rows(decontam.contaminated(docs, bench))
    assert sorted(r["doc_id"] for r in got) == [1, 5, 5]
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["start"], first["end"], first["edits"], first["item_id"]) == (7, 7 + len(passage), 0, 1)
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.without_leaks(docs, bench.limit(0)).count() == 7


def test_short_items_and_excerpts():
    passage = "A passage of the benchmark that is long enough to be evidence wherever it may stand in a text, and that goes on for more than two windows of it so that an excerpt is less than the whole."
    index = decontam.Index.of([(1, passage), (2, "forty two is it"), (3, "tiny")])
    for at in range(0, len(passage) - decontam.WINDOW - decontam.STRIDE + 1, 7):
        assert [h[0] for h in decontam.leaks("x" + passage[at : at + decontam.WINDOW + decontam.STRIDE - 1] + "y", index)] == [1]
    assert decontam.leaks("say forty  TWO is it.", index) == [(2, 4, 20, 0)]
    assert decontam.leaks("say forty two is italic, tiny", index) == []
    # enough equal q-grams in one place, but on no diagonal
    pieces = [passage[k : k + 14] for k in range(0, len(passage) - 14, 14)]
    assert decontam.leaks(" ".join(reversed(pieces)), index) == []


def test_items_that_cannot_be_searched_are_listed(spark):
    bench = spark.createDataFrame([(1, "long enough"), (2, " too \n short"[:6]), (None, "long enough too"), (3, None)], "item_id long, text string")
    assert sorted(r["item_id"] or 0 for r in decontam.unsearched(bench).collect()) == [0, 2, 3]


def test_repetitive_texts_stay_cheap():
    import time
    import tracemalloc

    index = decontam.Index.of([(k, "a " * 200) for k in range(20)])
    tracemalloc.start()
    begun = time.perf_counter()
    got = decontam.leaks("b " * 50 + "a " * 20_000 + "c " * 50, index)
    assert [g[0] for g in got] == list(range(20)) and all(g[1:] == (99, 40_100, 0) for g in got)
    assert tracemalloc.get_traced_memory()[1] < 400e6 and time.perf_counter() - begun < 60
    tracemalloc.stop()


def test_network_gradient_and_distribution():
    counts = np.array([5.0, 9, 7, 4, 3, 2, 1])
    net = gru_lm.Network.blank(counts, 4, 3)
    for k in ("inputs", "recur", "classes", "within"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    states = np.random.default_rng(0).normal(size=(1, 4))
    total = sum(np.exp(net.log_chance(states, np.array([t]))[0]) for t in range(len(counts)))
    assert np.isclose(total, 1)
    part = np.array([[1, 2, 3, 0, 6], [2, 2, 5, 1, 4]])

    def loss():
        state, out = np.zeros((2, 4)), 0.0
        for t in range(4):
            state = net.step(state, net.inputs[part[:, t]])[0]
            out -= net.log_chance(state, part[:, t + 1]).sum() / 8
        return out

    got, touched, _ = net.gradient(np.zeros((2, 4)), np.ascontiguousarray(part.T))
    grads = {**got, "inputs": np.zeros_like(net.inputs)}
    grads["inputs"][touched] = got["inputs"]
    for name, at in (("inputs", (2, 5)), ("recur", (1, 9)), ("recur", (0, 2)), ("classes", (2, 1)), ("within", (1, 3))):
        w = getattr(net, name)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert np.isclose(grads[name][at], (up - down) / 2e-5, rtol=1e-2, atol=1e-5)


def test_likelihoods_of_documents(spark):
    docs = awkward(spark).unionByName(documents(spark, [(k, "the cat sat on the mat and the dog ran off " * 3) for k in range(20, 60)]))
    got = rows(gru_lm.score(docs, head=8, coverage=0.6, hidden=4, classes=2, least=10_000))
    assert len(got) == 50
    words = {r["doc_id"]: (r["text"] or "").lower().encode().split() + [b""] for r in rows(docs) if r["doc_id"] is not None and r["doc_id"] != 6}
    train, counts = [r for r in rows(docs) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10], Counter()
    for r in train:
        counts.update(gru_lm.words_of((r["text"] or "").encode()) + [b""])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        if r["doc_id"] in words:
            own = words[r["doc_id"]]
            assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own) and r["train_tokens"] == n
            assert np.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
            assert r["score"] < 0
    assert gru_lm.score(documents(spark, [])).count() == 0


def by_hand(net, ids):
    """The likelihood of one id sequence, word by word in plain loops."""
    h, total = net.size, 0.0
    state = np.zeros(h)
    of = lambda i: max(c for c in range(len(net.first) - 1) if net.first[c] <= i)
    for i in ids:
        full, c = np.append(state, 1.0), of(i)
        logits = full @ net.classes
        total += logits[c] - math.log(sum(math.exp(x) for x in logits))
        inside = [full @ net.within[:, k] for k in range(net.first[c], net.first[c + 1])]
        total += inside[i - net.first[c]] - math.log(sum(math.exp(x) for x in inside))
        given, own = net.inputs[i], state @ net.recur
        update, reset = (1 / (1 + np.exp(-(given[k * h : (k + 1) * h] + own[k * h : (k + 1) * h]))) for k in (0, 1))
        state = state + update * (np.tanh(given[2 * h :] + reset * own[2 * h :]) - state)
    return total


def test_scores_equal_word_by_word_and_carry_state_across_windows():
    rng = np.random.default_rng(4)
    net = gru_lm.Network.blank(1 / np.arange(1.0, 30), 5, 6)
    net.recur *= 3
    texts = [rng.integers(0, 29, n) for n in (1, 3, 64, 65, 200, 64, 129)]
    want = [by_hand(net, t) for t in texts]
    assert np.allclose(net.score(texts, window=64), want, rtol=1e-4) and np.allclose(net.score(texts, window=7), want, rtol=1e-4)
    again = net.score([np.concatenate([texts[4][:64], texts[5]])])[0]
    assert abs(again - by_hand(net, texts[4][:64]) - by_hand(net, texts[5])) > 1e-3  # the first window is not forgotten


def test_training_uses_every_document_and_beats_the_unigram(spark):
    order = "alpha beta gamma delta epsilon zeta".split()
    docs = documents(spark, [(k, " ".join(order * 6)) for k in range(60)])
    got = rows(gru_lm.score(docs, hidden=8, coverage=0.95, classes=4, least=200_000))
    assert all(r["score"] > r["base_score"] / 2 for r in got)
    # a word that only one document has is known to the network once it is trained on all of them
    counts = gru_lm.word_counts(docs, docs.doc_id >= 0).collect()
    assert {bytes(r["word"]): (r["n"], r["m"]) for r in counts}[b""] == (60, 60)


def test_head_of_words_that_are_equally_common(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 1, 1) for k in range(3000)], "word binary, n long, m long")
    assert 800 < len(gru_lm.frequent(counts, 1000)) < 1200
    assert len(gru_lm.frequent(counts, 5000)) == 3000


def test_words_without_ids_of_their_own_have_chances_by_context(spark):
    import random

    rng = random.Random(5)
    docs = documents(spark, [(k, " ".join(f"{rng.randrange(10**6)}{('kal', 'tin')[i % 2]}" for i in range(200))) for k in range(200)])
    got = rows(gru_lm.score(docs, least=200_000))
    held = [r for r in got if r["held_out"]]
    # hardly a word is met twice, yet of two kinds only one can come next: log10(2) a token
    assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.2


def test_chances_of_all_words_sum_to_one(spark):
    docs = documents(spark, [(k, f"the {k}a cat {k}bcd sat {k}bcd on {k % 5}bcd") for k in range(2, 40)])
    counts = gru_lm.checkpointed(gru_lm.word_counts(docs, docs.doc_id >= 0))
    model = gru_lm.train(docs, counts, 30, 0.5, 4, 3, 1, 1, 7)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    of = {w: model.ids[model.words[w]] if w in model.words else model.ending[w] for w in n}
    inside = np.zeros(len(model.shared))
    for w, k in of.items():
        inside[k] += (n[w] + gru_lm.SMOOTH) / model.shared[k] if model.shared[k] else 1
    inside += np.where(model.shared, gru_lm.SMOOTH / np.where(model.shared, model.shared, 1), 0)
    assert np.allclose(inside, 1) and len(model.shared) == len({k for k in of.values() if not model.shared[k]}) + 7


def test_one_long_text_beside_short_ones_takes_few_softmax_calls(monkeypatch):
    net = gru_lm.Network.blank(1 / np.arange(1.0, 30), 5, 6)
    calls, plain = [], gru_lm.Network.log_chance
    monkeypatch.setattr(gru_lm.Network, "log_chance", lambda self, *a: calls.append(len(a[1])) or plain(self, *a))
    texts = [np.arange(n) % 29 for n in (3, 2000, 5)]
    made = net.score(texts)
    assert calls == [2008] and np.allclose(made, [by_hand(net, t) for t in texts], rtol=1e-4)
    assert len(net.score([])) == 0


def test_words_of_many_texts_are_those_of_each():
    texts = ["", " a  B\x0b", "  ", None, "x\x1cY\x85z\x0cÄ", "\x00 q", "  e f", "\t\n", "Ab ab\r\nAB"]
    for some in (pa.array(texts), pa.array(texts)[2:5], pa.array(texts[:1]), pa.array(texts, pa.large_string()), pa.array([], pa.string())):
        words, n = gru_lm.words_in(some)
        own = [gru_lm.words_of(t.as_py()) for t in some.cast(pa.binary())]
        assert n.tolist() == [len(w) for w in own] and words.to_pylist() == [w for ws in own for w in ws]
    ids = gru_lm.Ids({}, list(range(100, 107)))
    words = pa.array([b"a", b"ab", b"xabc", b"yabc", "é".encode()], pa.binary())
    assert ids.by_ending(words).tolist() == [ids[w] for w in words.to_pylist()] and len(ids.by_ending(words[:0])) == 0
    assert gru_lm.places(words, pa.array([b"xabc", b"a"], pa.binary())).tolist() == [1, -1, 0, -1, -1]


def test_gradient_takes_as_many_exps_for_many_classes_and_holds_for_large_weights(monkeypatch):
    net = gru_lm.Network.blank(1 / np.arange(1.0, 400), 6, 40)
    part = np.random.default_rng(3).integers(0, 399, (5, 300))
    calls, plain = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or plain(*a, **k))
    net.gradient(np.zeros((300, 6), np.float32), part)
    monkeypatch.undo()
    assert len(net.first) > 35 and len(calls) == 4 + 2  # one a step, one for all classes, one for the words in them
    net = gru_lm.Network.blank(np.array([5.0, 9, 7, 4, 3, 2, 1]), 4, 3)
    for k in gru_lm.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.within[-1] += 1000
    net.classes[-1] -= 1000
    part = np.array([[0, 2], [2, 2], [3, 5], [6, 1]])
    state = np.random.default_rng(5).uniform(-0.5, 0.5, (2, 4))
    got = net.gradient(state, part)[0]

    def loss():
        now, out = state, 0.0
        for t in range(3):
            now = net.step(now, net.inputs[part[t]])[0]
            out -= net.log_chance(now, part[t + 1]).sum() / 6
        return out

    for name, at in (("within", (1, 3)), ("within", (4, 5)), ("classes", (2, 1)), ("recur", (1, 9))):
        w, old = getattr(net, name), getattr(net, name)[at]
        w[at] = old + 1e-4
        up = loss()
        w[at] = old - 1e-4
        down = loss()
        w[at] = old
        assert np.isclose(got[name][at], (up - down) / 2e-4, rtol=1e-2, atol=1e-4)
