"""What the corpus operators share: folds, samples, checkpoints and text helpers."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every other byte stays.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(data: bytes, size: int) -> Iterator[bytes]:
    """The data in parts of about `size`, cut at spaces and line feeds only."""
    at = 0
    while at < len(data):
        ends = [e for e in (data.find(b" ", at + size), data.find(b"\n", at + size)) if e >= 0]
        yield data[at : (end := min(ends, default=len(data)))]
        at = end


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a local session gets one of its own; a cluster raises."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df` in no more partitions than so many rows need.

    Hundreds of shuffles of a few rows would else fill disk and memory by the number of their tasks and files.
    """
    return df.coalesce(8 + rows // 20_000)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def hash_sample(df: DataFrame, key: str, bound: int, rows: int | None = None) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of the key alone: the same rows in every run.

    All rows where there are no more than `bound`. The number of rows is counted unless given.
    """
    rows = df.count() if rows is None else rows
    if rows <= bound:
        return df
    share = int((1 << 30) * 0.97 * bound / rows)
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) < share)


def one_label(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and its label; documents with no label, or labelled both ways, have no row."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
        .where("_low = _high")
        .select("doc_id", F.col("_low").cast("int").alias("label"))
    )


def join_by_key(rows: DataFrame, one: DataFrame, key: str, n: str, total: int, most: int = 10_000) -> DataFrame:
    """`rows` joined to `one`, which has a single row for each key and in the column `n` the key's number of rows.

    Fewer than `most` keys can have more than a share of 1 / `most` of the `total` rows. These are broadcast, so a
    key with a third of all rows is not gathered in one task; the other keys are joined by a shuffle.
    """
    if total <= most:
        return rows.join(F.broadcast(one.drop(n)), key)
    hot = F.col(n) * F.lit(most) > F.lit(total)
    few = F.broadcast(one.where(hot).drop(n))
    others = rows.join(few.select(key), key, "left_anti").join(one.where(~hot).drop(n), key)
    return rows.join(few, key).unionByName(others)


def labelled(docs: DataFrame, labels: DataFrame, bound: int, column: str = "quality") -> DataFrame:
    """doc_id, text, label of about `bound` different labelled texts at most, chosen by hashes of doc_id and text.

    Rows with the same doc_id and text are one. A doc_id that many different texts share is thinned like many ids.
    """
    sample = hash_sample(one_label(labels, column), "doc_id", bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = checkpointed(rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", F.xxhash64("text").alias("_key")).agg(F.first("text").alias("text"), F.first("label").alias("label")))
    n = found.count()
    if n > bound:
        found = found.where(F.pmod(F.xxhash64("doc_id", "_key", F.lit("texts")), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return found.drop("_key")
