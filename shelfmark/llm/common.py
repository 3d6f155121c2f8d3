"""What several operators share: reading documents, order over a whole table, code on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import cut, ship  # noqa: F401

#: white space as the contracts define it
SPACE = r"[\x20\x09-\x0D]+"
SLICE_BITS = 33


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a missing text as the empty one; other columns, however named, stay out of the way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` written in ascending order over all partitions, with ``slice`` (number of the ordered part) and ``at`` (row in it).

    Parts are cut by ranges of the whole order, so a value that many rows share is spread as well. The result
    is a table: its numbers stay the same however often a task reads it.
    """
    n = shuffle_partitions(df.sparkSession)
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = cut(laid.withColumn("at", F.monotonically_increasing_id()))
    return table.withColumn("slice", F.shiftrightunsigned("at", SLICE_BITS)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << SLICE_BITS) - 1)))
