import random
import zlib

from helpers import rows
from pyspark.sql import functions as F

from tickloom.llm import langid, token_rollup

CHANGE = "source string, lang string, tokenizer string, version string, op string, n_tokens long, old_tokens long"


def test_every_language_is_learned_however_many(spark):
    docs, at = [], 0
    for k in range(250):
        rng = random.Random(k)
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)]
        for _ in range(9):
            docs.append((at, " ".join(rng.choice(words) for _ in range(30)), f"l{k:03d}"))
            at += 1
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(table)
    taught = {lang for i, _, lang in docs if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(model.langs) == taught and len(taught) > 240
    got = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    got = got[got["lang"].isin(taught)]
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["lang_pred"].nunique() > 220
    few = langid.train(table.where(F.col("doc_id") < 900), rows_in_all=300)
    assert set(few.langs) == {x for x in taught if x < "l100"}


def test_a_batch_committed_while_a_ledger_is_compacted_counts_once(spark, tmp_path, monkeypatch):
    make = lambda n: spark.createDataFrame([("s", None, "t", "1", "insert", n, None)], CHANGE)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "a"))
    rollup.commit("one", make(10))
    named = rollup._named

    def meanwhile():
        found = named()
        found.cache().count()
        rollup.commit("late", make(5))
        return found

    monkeypatch.setattr(rollup, "_named", meanwhile)
    other = rollup.compact(str(tmp_path / "b"))
    assert not other.commit("one", make(10))
    assert other.commit("late", make(5)) and not other.commit("late", make(5))
    assert [(r["n_docs"], r["n_tokens"]) for r in rows(other.totals())] == [(2, 15)]
    third = other.compact(str(tmp_path / "c"))
    assert third.committed("one") and third.committed("late") and rows(third.totals())[0]["n_tokens"] == 15
    empty = token_rollup.TokenRollup(spark, str(tmp_path / "d")).compact(str(tmp_path / "e"))
    assert empty.totals().count() == 0
