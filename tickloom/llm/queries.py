"""The numbered queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, collocations, gru_lm, langid, lexical
from tickloom.llm.common import checkpointed, fold, shared_dir, table
from tickloom.llm.decontam import contaminated
from tickloom.llm.html_template import extract
from tickloom.llm.line_crf import line_quality
from tickloom.llm.packing import pack
from tickloom.llm.quality_rules import quality_rules
from tickloom.llm.simhash import near_duplicates
from tickloom.llm.token_rollup import TokenRollup, changes, token_counts
from tickloom.llm.url_templates import judge

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`: doc_id, held_out, lang_pred, score. See `langid.identify` for nulls and ties."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every whole text of `documents`. See `quality_rules` for nulls and empty texts."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a fresh ledger over all documents, which come in by several batches.

    Every document is first inserted with a provisional count (its words) under an older tokenizer version, moved
    to the current one, and its count is revised; a fifth of the documents is deleted and inserted again; and one
    batch is delivered twice.
    """
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    counts = checkpointed(token_counts(table(spark, sf_dir, "documents")))
    words, ids = counts.where("tokenizer = 'words'"), counts.where("tokenizer <> 'words'")
    current = ids.withColumn("n_tokens", F.col("n_words"))
    older = current.withColumn("version", F.lit("words"))
    some = counts.where(F.coalesce(fold("doc_id", 5), F.lit(0)) == 0)
    for batch, rows in (
        ("load", changes(words, "insert").unionByName(changes(older, "insert"))),
        ("move", changes(older, "delete").unionByName(changes(current, "insert"))),
        ("count", changes(ids, "revise", "n_words")),
        ("withdraw", changes(some, "delete")),
        ("restore", changes(some, "insert")),
        ("count", changes(ids, "revise", "n_words")),
    ):
        rollup.commit(batch, rows)
    return rollup.totals()


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of `documents`: doc_id, held_out, score, predicted. See `line_crf.score` for nulls and empty texts."""
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document of `documents` and its place in a sequence. See `packing.pack` for nulls and repeated rows."""
    return pack(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 likelihoods of every whole text of `documents`. See `gru_lm.score` for nulls, empty texts and what is learned from."""
    return gru_lm.score(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every address of `pages`. See `url_templates.judge` for null and relative addresses."""
    return judge(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of `pages`. See `html_template.extract` for null and broken pages."""
    return extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of `documents` that holds text of `benchmark`. See `decontam.contaminated` for nulls and short items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of `documents`. See `simhash.near_duplicates` for null and wordless texts."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases with the highest scores of each language in `documents`. See `collocations.collocations` for nulls and ties."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of `documents` and the bytes they decode to, as digests. See `bpe.encode` for nulls."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of all `documents` for every item of `benchmark`. See `lexical.ranked` for nulls, ties and repeated rows."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_token_counts, op4_line_crf, op5_packing, op6_lm_scoring, op7_url_filters, op8_html_extraction, op9_decontamination, op10_simhash, op11_collocations, op12_bpe, op13_lexical_search)}
ORACLE_SQL: dict[str, str] = {"op11_collocations": collocations.SQL, "op13_lexical_search": lexical.SQL}
