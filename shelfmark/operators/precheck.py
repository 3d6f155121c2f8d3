"""Cheap compatibility check of catalogues and inventories by names, types and counts. No content is read.

``files``    collection, file_name
``entries``  collection, catalog, set_pos, set_name, entry_pos, entry_name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import tables as T
from shelfmark.operators.closest import closest_sets
from shelfmark.operators.ranking import position_in_group
from shelfmark.operators.reconcile import SCOPE, with_catalogs


def same_collection(catalogs: DataFrame, directories: DataFrame) -> DataFrame:
    """Catalogue x directory of exactly the same collection. Both sides: path, collection."""
    return catalogs.select("collection", F.col("path").alias("catalog_path")).join(
        directories.select("collection", F.col("path").alias("directory_path")), "collection")


def sets_of(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*SCOPE, "set_pos").agg(F.min("set_name").alias("set_name"))


def pair_by_name(files: DataFrame, sets: DataFrame) -> DataFrame:
    """The k-th set of a name key takes the k-th file of that key, and the first file once they run out."""
    keyed_sets = position_in_group(
        sets.select(*SCOPE, "set_pos", "set_name", N.normalize_name(F.col("set_name")).alias("name_key")),
        [*SCOPE, "name_key"], ["set_pos"],
    )
    keyed_files = position_in_group(
        files.select("collection", "file_name", N.normalize_name(N.stem(F.col("file_name"))).alias("name_key")).distinct(),
        ["collection", "name_key"], ["file_name"],
    )
    first = keyed_files.filter("k = 1").select("collection", "name_key", F.col("file_name").alias("first_file"))
    return (
        keyed_sets.join(keyed_files, ["collection", "name_key", "k"], "left")
        .join(first, ["collection", "name_key"], "left")
        .select(*SCOPE, "set_pos", "set_name", F.coalesce("file_name", "first_file").alias("file_name"))
    )


def files_without_set(files: DataFrame, pairs: DataFrame) -> DataFrame:
    taken = pairs.filter(F.col("file_name").isNotNull()).select(*SCOPE, "file_name").distinct()
    return (
        with_catalogs(files.select("collection", "file_name").distinct(), pairs)
        .join(taken, [*SCOPE, "file_name"], "left_anti").select(*SCOPE, "file_name")
    )


def result_rows(files: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per set (unverified or missing) and per file without a set, with the closest name."""
    matched = pairs.select(
        *SCOPE, "set_name", "file_name",
        N.package_name(F.col("set_name")).alias("expected_file_name"),
        F.when(F.col("file_name").isNotNull(), "unverified").otherwise("missing").alias("status"),
        F.lit("").alias("note"),
    )
    loose = closest_sets(files_without_set(files, pairs), sets)
    unmatched = loose.select(
        *SCOPE, N.stem(F.col("file_name")).alias("set_name"), "file_name",
        F.lit("").alias("expected_file_name"), F.lit("unmatched").alias("status"), "note",
    )
    return matched.unionByName(unmatched)


def profile(files: DataFrame, entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts, types and number of name matches per catalogue."""
    def types(c: Column) -> Column:
        ext = N.extension(c)
        return F.array_sort(F.collect_set(F.when(ext != "", ext)))

    listed = entries.groupBy(*SCOPE).agg(
        F.count_distinct("set_pos").alias("set_count"), types(F.col("entry_name")).alias("entry_types"))
    held = files.select("collection", "file_name").distinct().groupBy("collection").agg(
        F.count(F.lit(1)).alias("file_count"), types(F.col("file_name")).alias("file_types"))
    named = pairs.groupBy(*SCOPE).agg(F.count("file_name").alias("name_matches"))
    none = F.array().cast("array<string>")
    return (
        listed.join(held, "collection", "left").join(named, SCOPE, "left")
        .select(
            *SCOPE, "set_count", "entry_types", F.coalesce("file_count", F.lit(0).cast("bigint")).alias("file_count"),
            F.coalesce("file_types", none).alias("file_types"),
            F.coalesce("name_matches", F.lit(0).cast("bigint")).alias("name_matches"),
        )
    )


def shared_types(profiles: DataFrame) -> DataFrame:
    """Types both the catalogue and the files have."""
    return profiles.select(*SCOPE, F.array_sort(F.array_intersect("entry_types", "file_types")).alias("shared"))


def shown_types(c: Column) -> Column:
    return F.when(F.size(c) == 0, "(none)").otherwise(F.array_join(F.array_sort(c), ", "))


def rate(profiles: DataFrame) -> DataFrame:
    """Add rating and reason; the first rule that applies decides."""
    def any_of(column: str, values: list[str]) -> Column:
        return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))

    files_disc = any_of("file_types", T.DISC_FILE_TYPES)
    sets_store, sets_disc = any_of("entry_types", T.STORE_ENTRY_TYPES), any_of("entry_types", T.DISC_ENTRY_TYPES)
    packed = any_of("file_types", T.ARCHIVE_TYPES)
    overlap = F.arrays_overlap("entry_types", "file_types")
    n = F.col("name_matches")
    percent = n / F.col("set_count") * 100
    shown = F.bround(percent, 0).cast("int").cast("string")
    count = n.cast("string")
    expects = F.concat(
        F.lit("DAT expects "), shown_types(F.col("entry_types")), F.lit(", ROMs have "), shown_types(F.col("file_types")))
    rules = [
        (F.col("file_count") == 0, "red", F.lit("ROM directory is empty")),
        (F.col("set_count") == 0, "red", F.lit("DAT file has no games")),
        (sets_store & files_disc, "red",
         F.lit("DAT is for digital store packages but ROMs are disc dumps. Try Redump DATs.")),
        (files_disc & ~sets_disc & ~sets_store, "yellow",
         F.lit("ROMs are disc images but DAT expects cartridge dumps")),
        (~overlap & ~packed, "red", F.concat(F.lit("No extension match. "), expects)),
        (percent > 20, "green", F.concat(count, F.lit(" filename matches ("), shown, F.lit("% of DAT)"))),
        (n > 0, "yellow", F.concat(
            F.lit("Only "), count, F.lit(" filename matches ("), shown, F.lit("% of DAT). CRC scan may find more."))),
        (packed, "yellow",
         F.lit("No filename matches but extensions are compatible. CRC scan may find matches.")),
        (F.lit(True), "red", F.concat(F.lit("No filename matches. "), expects)),
    ]
    rating = reason = F
    for applies, colour, text in rules:
        rating, reason = rating.when(applies, colour), reason.when(applies, text)
    return profiles.withColumns({"rating": rating, "reason": reason})
