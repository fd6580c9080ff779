"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step links nodes to the smallest node they know; steps repeat until no link changes, in
a number of rounds that grows with the logarithm of the longest path.  Every round is written
to the shared folder and the one before removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trenchline.llm.tables import discard, stored


def star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b) with a > b."""
    pairs = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = pairs.join(least, "a")
    if large:  # larger neighbours go to the least one
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    both = joined.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return both.union(least.select("a", F.col("least").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node` and its component's least node, `root`; nodes without links do not appear."""
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")

    def signature(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, after = None, signature(now)
    while before != after:
        step = stored(star(star(now, True), False), "links")
        discard(now)
        now, before, after = step, after, signature(step)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
