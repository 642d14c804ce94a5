"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridertide.llm.tables import stage


def linked_to_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Each neighbour of a node linked to the least of the node and its neighbours instead."""
    both = links if larger_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if larger_only:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return new.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, class_id for all nodes of links (a, b): class_id is the least node that can be reached.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path."""
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("class_id"))
        before = digest
        # Large stars: larger neighbours move to the least; small stars: a node and its smaller ones do.
        now = stage(linked_to_least(stage(linked_to_least(now, False)), True))
