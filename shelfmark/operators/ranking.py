"""Exact positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import cut


def position_in_group(df: DataFrame, keys: list[str], order: list[str], out: str = "k") -> DataFrame:
    """1-based position of every row in its group, in ``order`` (which must be unique per group).

    ``row_number`` over the group would sort a hot group in one task. Here the rows are range
    partitioned by (keys, order), so a hot group spreads over many tasks; each slice is numbered
    on its own and shifted by the sizes of the slices before it. The sliced rows are written to
    the shared folder once, so that both uses see the same slices.
    """
    cols = [*keys, *order]
    sliced = cut(df.repartitionByRange(*cols).withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_in", F.row_number().over(inside))
    joined = numbered.alias("l").join(
        shifts.alias("r"),
        [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "_slice"]],
    )
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._in") + F.col("r._shift")).cast("bigint").alias(out),
    )
