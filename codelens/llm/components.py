"""Connected components of a table of links, by joins; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.common import store


def _smallest(links: DataFrame) -> DataFrame:
    # Stored, so that the join below shuffles both sides and can split a node with many links.
    return store(links.groupBy("a").agg(F.min("b").alias("least")), "smallest")


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both).withColumn("least", F.least("a", "least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _smallest(down)
    moved = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node that is not its component's smallest.

    ``links`` has two columns of one ordered type. Large and small stars take
    turns until nothing changes, which takes about the logarithm of the longest
    chain; each turn is stored. Links of a node to itself and null links do
    nothing; repeated links do no harm.
    """
    first, second = links.columns
    now = links.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b")
    now = store(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
        now = store(_small_star(store(_large_star(now), "large-star")), "small-star")
