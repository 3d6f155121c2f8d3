"""Regional variants: preferred regions and one file per set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names as N


def preference_rank(text: Column, preferences: list[str]) -> Column:
    """Position of the first preference that occurs in the text, ignoring case; their number if none does."""
    rank = F
    for i, wanted in enumerate(preferences):
        rank = rank.when(F.lower(text).contains(wanted.lower()), i)
    return rank.otherwise(len(preferences)) if preferences else F.lit(0)


def region_exclusions(matched: DataFrame, preferences: list[str]) -> DataFrame:
    """Add ``region_rank`` and ``excluded`` per (collection, title); an empty list excludes nothing.

    ``matched``: collection, file_name, set_name. All rows at the best rank of a title stay; a
    title without any preferred region goes as a whole.
    """
    if not preferences:
        return matched.withColumns({"region_rank": F.lit(0), "excluded": F.lit(False)})
    ranked = matched.withColumns({
        "title": N.extract_base_name(F.col("set_name")),
        "region_rank": preference_rank(N.extract_region(F.col("set_name")), preferences),
    })
    best = ranked.groupBy("collection", "title").agg(F.min("region_rank").alias("_best"))
    out = (F.col("region_rank") > F.col("_best")) | (F.col("_best") >= len(preferences))
    return ranked.join(best, ["collection", "title"]).withColumn("excluded", out).drop("_best", "title")


def _pool(queue: DataFrame, preferences: list[str]) -> DataFrame:
    name = F.when(F.coalesce("set_name", F.lit("")) == "", F.col("file_name")).otherwise(F.col("set_name"))
    return queue.withColumns({"name": name, "rank": preference_rank(name, preferences)})


def _winners(pool: DataFrame) -> DataFrame:
    return pool.groupBy("collection", "name").agg(
        F.min_by(F.struct(F.col("file_name").alias("winner")), F.struct("rank", "queue_pos")).alias("w"),
    ).select("collection", "name", "w.winner")


def new_items(items: DataFrame, queued: DataFrame) -> DataFrame:
    """Items not queued yet by (file, collection)."""
    return items.join(queued.select("file_name", "collection").distinct(), ["file_name", "collection"], "left_anti")


def one_file_per_set(queue: DataFrame, preferences: list[str]) -> DataFrame:
    """Keep one queued file per set: best region, first in the queue on ties.

    ``queue``: collection, file_name, set_name, queue_pos, is_new; old rows come before new ones.
    """
    pool = _pool(queue, preferences)
    won = _winners(pool).select("collection", F.col("winner").alias("file_name")).distinct()
    return pool.join(won, ["collection", "file_name"], "left_semi").drop("name", "rank")


def queue_conflicts(queue: DataFrame, preferences: list[str]) -> DataFrame:
    """New items that lost, with what was kept instead."""
    pool = _pool(queue, preferences)
    return (
        pool.join(_winners(pool), ["collection", "name"])
        .filter((F.col("winner") != F.col("file_name")) & F.col("is_new"))
        .select("collection", F.col("name").alias("kept"), F.col("winner").alias("kept_file"),
                F.col("file_name").alias("dropped_file"))
    )
