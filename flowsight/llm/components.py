"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsight.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    # A sum of digests names the set of links; it is a decimal, so it cannot overflow.
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(links.agg(F.count(F.lit(1)), digest).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root): for each node with a link, the smallest node it can reach.

    links has BIGINT columns a and b in any order; repeated links and a = b are allowed (a node linked only to
    itself is left out). No links: no rows. Nulls are not links. Links stay in Spark; the driver sees one count and
    one digest per round, and rounds grow with the logarithm of the longest chain.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links)
    before = None
    while (now := _state(links)) != before:
        before = now
        if not now[0]:
            break
        links = stored(_small_star(_large_star(links)))
    # At the end each node points at the smallest node of its component.
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
