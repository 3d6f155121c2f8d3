"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    The minimum of a node's neighbours is a partial aggregate, so a node with very many neighbours costs a row a task;
    every step is written, and the loop ends when a step changes nothing.
    """
    links = cut(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        both = links.union(links.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        # the rows are counted and digested as they are written
        seen = Observation()
        links = cut(small.union(least.toDF("hi", "lo")).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("digest")))
        now = seen.get
        if now == before:
            break
        before = now
    # every node now hangs on its root; roots themselves are only on the low side
    return links.toDF("node", "component").union(links.select("lo", "lo").distinct())
