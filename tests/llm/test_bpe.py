import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, documents, rows

from tickloom.llm import bpe
from tickloom.llm.tokens import Vocabulary, encoder


@pytest.fixture(scope="module")
def exact():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(ranks, piece):
    """The definition: merge the leftmost pair of the lowest rank until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_queue_gives_lowest_rank_then_lowest_position():
    rng = random.Random(4)
    queue, held = bpe.RankQueue(70_000), []
    for _ in range(4000):
        if held and rng.random() < 0.5:
            held.sort()
            assert queue.pop() == held.pop(0)
        else:
            entry = (rng.choice([0, 255, 256, 65_535, 65_536, 69_999, rng.randrange(70_000)]), rng.randrange(1000))
            held.append(entry)
            queue.push(*entry)
    assert [queue.pop() for _ in held] == sorted(held) and queue.pop() is None


def test_merges_equal_the_definition_where_ranks_run_against_lengths():
    rng = random.Random(5)
    for _ in range(60):
        # ranks in no order of growth, so that a merge can make a pair of a lower rank than its own
        tokens = {bytes([b]) for b in b"abc"} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
        ranks = dict(zip(tokens, rng.sample(range(600), len(tokens)), strict=True))
        lines = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
        made = bpe.Bpe(Vocabulary("x", lines, r"\S+"))
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60)))
            assert made.merge(piece) == plain(ranks, piece)


def test_ids_are_those_of_tiktoken(exact):
    made = bpe.Bpe(Vocabulary.load())
    rng = random.Random(6)
    texts = ["", " ", "a", "don't  stop\n\n \t x", "<|endoftext|>", "ab" * 5000, "x" * 60_000, "　\x1c\x85 é", "\U0001f600" * 300]
    texts += ["".join(rng.choice(["the ", "ciónñ", "\n", "'ll", "9", "  ", "ß", "中文", "!!", "zq", "́", "\x00"]) for _ in range(rng.randint(1, 400))) for _ in range(200)]
    for text in texts:
        ids = made.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(text)
        assert made.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        made.decode(b"\xff\xff\xff\x7f")


def test_long_texts_and_a_full_memory_change_nothing(exact, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 7)
    made, text = bpe.Bpe(Vocabulary.load()), "several different words in a long text, 123 of them " * 9
    ids = made.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(text) and made.decode(ids) == text.encode() and len(made) <= 7


def test_round_trip_of_whole_tables(spark, exact):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = rows(bpe.round_trip(docs))
    assert len(got) == docs.count()
    for r in got:
        ids = np.array(exact.encode_ordinary(texts[r["doc_id"]]), dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_awkward_rows(spark):
    got = rows(bpe.round_trip(awkward(spark)))
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == awkward(spark).count()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, empty, empty) for r in got if r["doc_id"] in (0, 1))
    assert sum(r["doc_id"] == 4 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert bpe.round_trip(documents(spark, [])).count() == 0


def test_two_vocabularies_of_one_name(spark):
    whole = Vocabulary.load()
    letters = Vocabulary(whole.name, b"\n".join(whole.lines.splitlines()[:256]), whole.pattern)
    docs = documents(spark, ["the same words"])
    assert [rows(bpe.round_trip(docs, v))[0]["n_tokens"] for v in (whole, letters)] == [3, 14]
    # in one process: the counts booked under a version are that version's
    assert [len(encoder(v).encode("the same words")) // 4 for v in (whole, letters)] == [3, 14]


def test_single_positions_stand_in_the_queue_without_lists(exact):
    made = bpe.Bpe(Vocabulary.load())
    queue = made.queue
    queue.push(9, 4)
    assert queue.buckets[9] == 4 and queue.pop() == (9, 4)
    for piece in ("abab" * 40, " intionhe", "zq" * 9, "\U0001f600" * 20):
        assert made.merge(piece.encode()) == exact.encode_ordinary(piece)
        assert set(queue.buckets) == {None} and not any(queue.words) and not queue.top
