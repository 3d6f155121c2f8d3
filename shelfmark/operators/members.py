"""Archive members: which one is the primary content of its file.

``members``  collection, file_name, member_pos, member_name, size, crc
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import tables as T

FILE = ["collection", "file_name"]


def in_list(accepted: Column) -> Column:
    return F.coalesce(F.array_contains(accepted, N.extension(F.col("member_name"))), F.lit(False))


def accepted_members(members: DataFrame, accepted: Column) -> DataFrame:
    """Members of an accepted type; all members of files that have none."""
    tagged = members.withColumn("_in", in_list(accepted))
    some = tagged.groupBy(*FILE).agg(F.bool_or("_in").alias("_any"))
    return tagged.join(some, FILE).filter(F.col("_in") | ~F.col("_any")).drop("_in", "_any")


def primary_members(members: DataFrame, accepted: Column) -> DataFrame:
    """Accepted types first, then the largest, then the first. One aggregate, no sort of an archive."""
    order = F.struct(~in_list(accepted), -F.col("size"), F.col("member_pos"))
    pick = F.struct("member_name", "member_pos", "size", "crc")
    return (
        members.groupBy(*FILE).agg(F.min_by(pick, order).alias("p"), F.count(F.lit(1)).alias("n_members"))
        .select(*FILE, "p.*", N.member_type(F.col("p.member_name")).alias("member_type"), "n_members")
    )


def file_hashes(loose: DataFrame, primary: DataFrame) -> DataFrame:
    """One hash per file: the stored one of the primary member, else that of the content.

    ``loose``: collection, file_name, hash of the whole content.
    """
    inner = primary.select(*FILE, F.col("member_name"), F.lower("crc").alias("crc"))
    return loose.join(inner, FILE, "left").select(
        *FILE, "member_name", F.coalesce("crc", "hash").alias("hash")
    )


def member_rows(members: DataFrame) -> DataFrame:
    """Members with their type and ``group_ord``, which puts well-known content types first."""
    kind = N.member_type(F.col("member_name"))
    return members.select(
        *FILE, (~kind.isin(T.PRIMARY_TYPES)).cast("int").alias("group_ord"), "member_pos", "member_name",
        kind.alias("member_type"), "size", "crc",
    )


def member_table(members: DataFrame, by_size: bool = False) -> DataFrame:
    """Sorted for display: content types first in archive order, or the largest member first."""
    order = [F.desc("size"), "member_pos"] if by_size else ["group_ord", "member_pos"]
    return member_rows(members).orderBy(*FILE, *order)


def format_notes(primary: DataFrame, entry_types: DataFrame, accepted: Column) -> DataFrame:
    """Files whose primary member has a type the catalogue does not list.

    ``primary``: FILE, member_name; ``entry_types``: collection, catalog, types (array, with dot).
    """
    ext = N.extension(F.col("member_name"))
    listed = F.array_join(F.array_sort("types"), ", ")
    text = F.concat(
        F.lit("Format note: ROM inside archive is "), ext, F.lit(", DAT expects "),
        F.when(listed == "", "unknown").otherwise(listed),
        F.lit(". May need conversion (e.g. byte-order swap for N64)."),
    )
    return (
        primary.filter(accepted.isNotNull() & (ext != "")).join(entry_types, "collection")
        .filter(~F.array_contains("types", ext))
        .select("collection", "catalog", "file_name", text.alias("note"))
    )


def entry_types(entries: DataFrame) -> DataFrame:
    """Distinct member types a catalogue lists."""
    return (
        entries.filter(F.col("entry_name") != "")
        .groupBy("collection", "catalog")
        .agg(F.collect_set(N.extension(F.col("entry_name"))).alias("types"))
    )
