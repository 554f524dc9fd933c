"""Connected components of a large graph by alternating star contractions.

Each round, every node's larger neighbours are hung on its smallest neighbour (large star), then its
smaller ones are (small star); rounds grow with the logarithm of the longest path. A node's minimum is
an aggregate with map-side partials that is joined back on: the few nodes with a large share of all links
by broadcast, the others by a shuffle, so the links of a hub are never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, few, join_by_key, release

Tidy = Callable[[DataFrame], DataFrame]


def _large_star(edges: DataFrame, total: int, tidy: Tidy) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = tidy(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
    return tidy(join_by_key(both, least, "a", "n", 2 * total).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _small_star(edges: DataFrame, total: int, tidy: Tidy) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = tidy(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = join_by_key(down, least, "a", "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tidy(moved.union(least.select("a", F.col("m").alias("b")))).distinct()


def components(edges: DataFrame, first: str = "a", second: str = "b", tidy: bool = False) -> DataFrame:
    """node, component: for each node of an undirected edge list, the smallest node it reaches.

    Nodes are longs. Links with a null end and loops are ignored; an empty list gives an empty table.
    The driver sees two numbers a round, never the edges. `tidy` is for many small lists: every step is in few partitions,
    and their shuffle files go at the end, as hundreds of shuffles of a few rows fill a disk by their number.
    """
    edges = (
        edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    total = edges.count() if tidy else 0

    def tidied(rows: DataFrame) -> DataFrame:
        return few(rows, total) if tidy else rows

    edges = checkpointed(tidied(tidied(edges).distinct()))
    seen = (edges.count(), None)
    while seen[0]:
        hung = checkpointed(tidied(_large_star(edges, seen[0], tidied)))
        edges = checkpointed(tidied(_small_star(hung, seen[0], tidied)))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    if not tidy:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.distinct())
    made = checkpointed(tidied(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tidied(tops.distinct()))))
    release(edges.sparkSession)
    return made
