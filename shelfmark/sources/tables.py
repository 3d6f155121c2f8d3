"""Result tables: scoped refresh by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh(df: DataFrame, path: str, whole: bool = False) -> None:
    """Replace the collections present in ``df``, or with ``whole`` the entire table.

    Only the partitions written are touched, so a refresh of one collection costs that collection.
    A collection without any row left is cleared by ``refresh_collection``.
    """
    writer = df.write.partitionBy("collection").mode("overwrite")
    writer.option("partitionOverwriteMode", "static" if whole else "dynamic").parquet(path)


def _partition_name(value: str) -> str:
    """Directory name Spark gives a partition value."""
    special = set("\"#%'*/:=?\\{[]^\x7f")
    return "".join(f"%{ord(c):02X}" if c in special or ord(c) < 32 else c for c in value)


def refresh_collection(df: DataFrame, path: str, collection: str) -> None:
    """Clear one collection and write its rows, also when there are none left."""
    rows = df.filter(F.col("collection") == collection).drop("collection")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        f"{path}/collection={_partition_name(collection)}")


def keep_collections(df: DataFrame, configured: DataFrame) -> DataFrame:
    """Rows of collections that are still configured."""
    return df.join(configured.select("collection").distinct(), "collection", "left_semi")


def write_precheck(profiles: DataFrame, rows: DataFrame, profile_path: str, rows_path: str) -> None:
    """Both outputs of a precheck."""
    refresh(profiles, profile_path)
    refresh(rows, rows_path)
