"""Hash reconcile: which expected entries are held, and what that says about each set.

``entries``  collection, catalog, set_pos, set_name, entry_pos, entry_name, size, hash
             (a set without entries has one row with NULL entry columns)
``hashes``   collection, file_name, member_name (NULL for loose files), hash
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCOPE = ["collection", "catalog"]


def _usable(hash_col="hash"):
    return F.col(hash_col).isNotNull() & (F.col(hash_col) != "")


def first_sources(hashes: DataFrame) -> DataFrame:
    """One row per (collection, hash): the first file that holds it and how many do.

    A plain aggregate, so copies of one popular content collapse before the shuffle.
    """
    return (
        hashes.filter(_usable())
        .groupBy("collection", F.lower("hash").alias("hash"))
        .agg(F.min(F.struct("file_name", "member_name")).alias("source"), F.count(F.lit(1)).alias("n_copies"))
    )


def entry_results(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Status of every (set, entry name). The first file wins; one file may satisfy many entries."""
    found = first_sources(hashes)
    # entries without a usable hash can have no source: they go around the join, where they would be one hot key
    asked = entries.filter(_usable()).withColumn("hash", F.lower("hash")).join(found, ["collection", "hash"], "left")
    blank = entries.filter(~F.coalesce(_usable(), F.lit(False)))
    wanted = asked.unionByName(blank, allowMissingColumns=True)
    return (
        wanted
        .groupBy(*SCOPE, "set_pos", "entry_name")
        .agg(
            F.min("set_name").alias("set_name"),
            F.min("entry_pos").alias("entry_pos"),
            F.count("entry_name").alias("n_entries"),
            F.max("size").alias("size"),
            F.min("source").alias("source"),
        )
        .select(
            *SCOPE, "set_pos", "set_name", "entry_pos", "entry_name", "n_entries", "size",
            F.when(F.col("source").isNotNull(), "ok").otherwise("missing").alias("status"),
            F.col("source.file_name").alias("file_name"),
            F.col("source.member_name").alias("member_name"),
        )
    )


def set_results(results: DataFrame) -> DataFrame:
    """Roll entry results up to one row per set, with the source of its first entry."""
    found = F.when(F.col("status") == "ok", F.col("n_entries")).otherwise(0)
    first = F.struct("file_name", "member_name")
    rolled = results.groupBy(*SCOPE, "set_pos").agg(
        F.min("set_name").alias("set_name"),
        F.sum("n_entries").alias("expected"),
        F.sum(found).alias("found"),
        F.min_by(first, "entry_pos").alias("first"),
    )
    return rolled.select(
        *SCOPE, "set_pos", "set_name", "expected", "found",
        F.col("first.file_name").alias("file_name"),
        F.col("first.member_name").alias("member_name"),
        F.concat("set_name", F.lit(".zip")).alias("expected_file_name"),
        set_status(F.col("expected"), F.col("found")).alias("status"),
    )


def set_status(expected, found):
    """No entries or all held: ok; none held: missing; some held: bad_dump."""
    return F.when(expected == found, "ok").when(found == 0, "missing").otherwise("bad_dump")


def status_counts(sets: DataFrame) -> DataFrame:
    ok, missing = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "missing")
    return sets.groupBy(*SCOPE).agg(
        ok.alias("n_ok"), missing.alias("n_missing"), (F.count(F.lit(1)) - ok - missing).alias("n_other")
    )


def missing_entries(results: DataFrame) -> DataFrame:
    return results.filter((F.col("status") == "missing") & F.col("entry_name").isNotNull())


def wanted_hashes(entries: DataFrame) -> DataFrame:
    """One row per (collection, catalog, hash)."""
    return entries.filter(_usable()).select(*SCOPE, F.lower("hash").alias("hash")).distinct()


# parts a collection's files are dealt out to when every file meets every catalogue of the collection
SALTS = 64


def with_catalogs(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Each row of ``files`` (collection, file_name, ...) with each catalogue of its collection.

    Joined on the collection alone, all its files would meet in one partition: the short list of
    catalogues is repeated for each part of the file names instead, whatever the sizes.
    """
    salted = entries.select(*SCOPE).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    part = F.pmod(F.xxhash64("file_name"), F.lit(SALTS)).cast("int")
    return files.withColumn("_part", part).join(salted, ["collection", "_part"]).drop("_part")


def unmatched_files(hashes: DataFrame, entries: DataFrame) -> DataFrame:
    """Files none of whose contents is wanted by the catalogue, for each catalogue of the collection."""
    hits = (
        hashes.filter(_usable()).select("collection", "file_name", F.lower("hash").alias("hash"))
        .join(wanted_hashes(entries), ["collection", "hash"])
        .select(*SCOPE, "file_name").distinct()
    )
    return (
        with_catalogs(hashes.select("collection", "file_name").distinct(), entries)
        .join(hits, [*SCOPE, "file_name"], "left_anti")
    )


def rebuildable_sets(sets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Sets that are complete and not written yet; ``existing`` holds package names already there."""
    full = sets.filter((F.col("expected") > 0) & (F.col("expected") == F.col("found")))
    if existing is None:
        return full
    return full.join(existing.select("expected_file_name").distinct(), "expected_file_name", "left_anti")
