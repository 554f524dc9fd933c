"""Token counts as delta-maintained rollups.

Changes to documents (inserts, deletes, revised counts) become signed additive totals by source, language,
tokenizer and tokenizer version. A batch of changes is written as a run of its own and counts from the moment
its pointer, a small file named after the batch, is moved into place; until then, and after a crash, nothing of
it is seen. A batch whose pointer is there is left alone, so a retry counts once. Totals are the sum over the
runs that pointers name; `compact` folds them into one run and remembers the ids of the batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tokens import Vocabulary, encoder
from tickloom.ship import in_arrow

KEYS = ["source", "lang", "tokenizer", "version"]
TOTALS = ["n_docs", "n_tokens"]
LEDGER = "source string, lang string, tokenizer string, version string, n_docs long, n_tokens long, run string"
#: The version of the tokens "words": runs of what is no ASCII white space.
WORDS_VERSION = "1"


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, version, n_tokens, n_words: two rows a document, its BPE ids and its words.

    Null and empty texts have 0 tokens. Repeated rows each have their own. Extra columns are ignored.
    """
    vocabulary = vocabulary or Vocabulary.load()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kept = [batch.column(c) for c in ("doc_id", "source", "lang")]
            ids = np.array([len(encode(t)) // 4 for t in texts], dtype=np.int64)
            words = np.array([len(t.encode().split()) if t else 0 for t in texts], dtype=np.int64)
            for name, version, n in ((shared.value.name, shared.value.version, ids), ("words", WORDS_VERSION, words)):
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x] * len(n), pa.string()) for x in (name, version)), pa.array(n), pa.array(words)], names=["doc_id", *KEYS, "n_tokens", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    return in_arrow(rows, run, "doc_id long, source string, lang string, tokenizer string, version string, n_tokens long, n_words long")


def changes(counts: DataFrame, op: str, old: str | None = None) -> DataFrame:
    """Every row of `counts` as a change: `insert` or `delete` of a document, or `revise` from the column `old`."""
    return counts.select(*KEYS, F.lit(op).alias("op"), "n_tokens", (F.col(old) if old else F.lit(None)).cast("long").alias("old_tokens"))


class TokenRollup:
    """A ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def committed(self, batch: str) -> bool:
        """Whether the batch counts, by a pointer of its own or as part of what was compacted."""
        if self._files.exists(self._path(f"pointers/batch-{batch}")):
            return True
        return self._files.exists(self._path("folded")) and not self.spark.read.schema("id string").parquet(f"{self.folder}/folded").where(F.col("id") == batch).isEmpty()

    def _point(self, name: str, run: str) -> None:
        """Make the run count: the pointer is written aside and moved, so it is there whole or not at all."""
        aside = self._path(f"aside/{uuid.uuid4().hex}")
        out = self._files.create(aside, True)
        out.write(bytearray(run.encode()))
        out.close()
        self._files.mkdirs(self._path("pointers"))
        # of two that move the same name one stays, and each names a run with the same rows
        if not self._files.rename(aside, self._path(f"pointers/{name}")):
            self._files.delete(aside, False)

    def _write(self, totals: DataFrame) -> str:
        run = uuid.uuid4().hex
        totals.write.parquet(f"{self.folder}/ledger/run={run}")
        return run

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes (source, lang, tokenizer, version, op, n_tokens, old_tokens); False where it counts already.

        insert: one document and its tokens more; delete: as many less; revise: n_tokens instead of
        old_tokens. Other ops and null counts raise. Nulls in the keys are a group of their own, repeated rows
        count each, extra columns are ignored and an empty batch is committed like any.
        """
        if not batch or "/" in batch or "=" in batch or ":" in batch:
            raise ValueError("a batch id is a plain name")
        if self.committed(batch):
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
        given = F.coalesce("n_tokens", F.raise_error(F.lit("n_tokens is null")).cast("long"))
        old = F.coalesce("old_tokens", F.raise_error(F.lit("old_tokens is null")).cast("long"))
        tokens = F.when(F.col("op") == "revise", given - old).otherwise(sign * given)
        self._point(f"batch-{batch}", self._write(changes.select(*KEYS, sign.cast("long").alias("n_docs"), tokens.alias("n_tokens")).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS))))
        return True

    def _named(self) -> DataFrame:
        """run, id: the runs that count, and the batch of each (empty for what was compacted)."""
        if not self._files.exists(self._path("pointers")):
            return self.spark.createDataFrame([], "run string, id string")
        name = F.regexp_extract(F.col("_metadata.file_path"), "/batch-([^/]*)$", 1)
        return self.spark.read.text(f"{self.folder}/pointers").select(F.col("value").alias("run"), F.url_decode(name).alias("id"))

    def _totals(self, named: DataFrame) -> DataFrame:
        if not self._files.exists(self._path("ledger")):
            return self.spark.createDataFrame([], LEDGER).drop("run")
        runs = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger")
        rows = runs.join(named.select("run").distinct(), "run", "left_semi").groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS))
        return rows.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, version, n_docs, n_tokens; groups that deletes have emptied are left out."""
        return self._totals(self._named())

    def compact(self, folder: str) -> TokenRollup:
        """A new ledger in `folder`, which must not have one, whose first run holds this one's totals and which knows its batches.

        Both are those of one list of pointers, read once and written down: a batch committed meanwhile is in neither, and
        counts when it is delivered to the new ledger.
        """
        other = TokenRollup(self.spark, folder)
        if other._files.exists(other._path("pointers")):
            raise ValueError("there is a ledger in that folder")
        self._named().write.mode("overwrite").parquet(f"{other.folder}/snapshot")
        named = self.spark.read.schema("run string, id string").parquet(f"{other.folder}/snapshot")
        known = named.select("id").where("id <> ''")
        if self._files.exists(self._path("folded")):
            known = known.union(self.spark.read.schema("id string").parquet(f"{self.folder}/folded"))
        known.write.mode("overwrite").parquet(f"{other.folder}/folded")
        other._point("folded", other._write(self._totals(named)))
        return other
