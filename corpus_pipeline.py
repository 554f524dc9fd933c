"""The corpus pipeline: rules, classifier, near-duplicates, benchmark leaks, packing.

All stages take empty tables, repeated rows, nulls in any column and extra columns whatever their names; texts are
used whole. What a stage does with such rows is in its docstring.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage returns to the
shared folder as Parquet and hands the rereading to the next. All stages but the last return the columns
of `documents`, extra ones included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontam, jaccard, line_crf, packing, quality_rules
from tickloom.llm.common import shared_dir, table


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base heuristic nor a learned rule rejects; learned from the whole table.

    Null and empty texts go, as they have fewer than ten words. Repeated rows and rows without a doc_id are judged each
    by their own text.
    """
    rules = quality_rules.fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at 0.5 or more.

    It learns from the whole table: of what the rules have left, hardly a bad document is there to learn from.
    Null and empty texts score the training share of label 1; without labels of both kinds all rows stay. Repeated
    rows and rows without a doc_id are judged each by their own text.
    """
    return line_crf.keep_good(docs, line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more, the one with the smallest doc_id.

    SimHash fingerprints that meet at anchors come first and are checked on the sets. Fingerprints of such pairs differ
    in up to 11 bits on the given tables, beyond what anchors can reach, so an exact set join finds the rest. Null and wordless texts are one group. Of repeated rows one stays; where different
    texts share a doc_id each is judged by its own group; a row without a doc_id stays only where its group has
    none with one.
    """
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text.

    Null and empty texts stay, and all rows where the benchmark is empty; null items match nothing. Repeated rows and
    rows without a doc_id are judged each by their own text.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, and their places in sequences.

    A null or empty text is one token. Repeated rows are packed each for itself, a null doc_id stays null, and extra
    columns are left out; no document gives no row.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", rule_stage),
    ("quality classifier", classifier_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Learned verdicts, fingerprints and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
