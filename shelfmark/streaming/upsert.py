"""Live row updates by key, merged on read.

A batch appends the last update of each of its keys under its own batch id, so the cost of a
batch is the size of the batch and a replayed batch overwrites itself. Readers take the latest
update per key; ``compact`` folds the log into one new base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_per_key(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last update of every key, as a mergeable aggregate."""
    cols = updates.columns
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_u")).select("_u.*")


def start(updates: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], **trigger):
    """Start the query. ``path`` receives one partition per batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        last_per_key(batch, keys, order).withColumn("batch_id", F.lit(batch_id)).write.partitionBy("batch_id").mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return (
        updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key over all batches written so far."""
    return last_per_key(spark.read.parquet(path), keys, ["batch_id", *order]).drop("batch_id")


def replace_rows(rows: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of an updated key give way to its update; new keys are added. ``updates``: one row per key."""
    kept = rows.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(*rows.columns))


def compact(spark: SparkSession, path: str, target: str, keys: list[str], order: list[str]) -> None:
    """Write the current rows as a base of their own."""
    current(spark, path, keys, order).withColumn("batch_id", F.lit(-1)).write.partitionBy("batch_id").mode(
        "overwrite").parquet(target)
