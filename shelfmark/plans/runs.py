"""Whole runs over a folder of catalogues and folders of files: scan, precheck, analyse, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import dispatch as D
from shelfmark.functions import names as N
from shelfmark.operators import candidates, collections, members as ME, precheck as PC, reconcile
from shelfmark.operators.closest import closest_sets
from shelfmark.plans import rules, writer
from shelfmark.session import cut
from shelfmark.sources import catalogs as CA
from shelfmark.sources import inventory as IN

FILE = ["collection", "file_name"]


@dataclass
class Shelf:
    """What all runs read, each written once: entries of the catalogues and readings of the files."""

    entries: DataFrame
    files: DataFrame
    members: DataFrame
    variants: DataFrame
    problems: DataFrame

    @property
    def sets(self) -> DataFrame:
        return PC.sets_of(self.entries)

    @property
    def hashes(self) -> DataFrame:
        """Every member of an archive and every loose file, with its hash."""
        packed = self.members.filter("error IS NULL AND member_name IS NOT NULL").select(*FILE, "member_name", F.col("crc").alias("hash"))
        loose = self.variants.filter("kind = 'raw' AND error IS NULL").join(packed.select(*FILE).distinct(), FILE, "left_anti")
        return packed.unionByName(loose.select(*FILE, F.lit(None).cast("string").alias("member_name"), "hash"))


def open_shelf(spark: SparkSession, catalogs: str, *folders: str) -> Shelf:
    """Read catalogues and folders. A catalogue serves each folder whose name it matches; what cannot be read is in ``problems``."""
    heads = CA.discover_catalogs(spark, catalogs).select(CA._key(F.col("catalog_path")).alias("key"), F.col("name").alias("catalog"), F.col("collection").alias("catalog_name"))
    files = cut(IN.list_files(spark, *folders))
    names = files.select("collection").distinct()
    serves = collections.catalogs_for_collections(heads.select(F.col("key").alias("catalog_path"), "catalog_name"), names)
    plain = CA.read_entries(spark, catalogs)
    every = plain.unionByName(CA.read_zipped_entries(spark, catalogs).filter("error IS NULL").drop("error"))
    entries = (
        every.withColumn("key", CA._key(F.col("catalog_path"))).join(heads.select("key", "catalog"), "key")
        .join(serves.select(F.col("catalog_path").alias("key"), "collection"), "key")
        .select("collection", "catalog", "set_pos", "set_name", "description", F.coalesce("entry_pos", F.lit(0)).alias("entry_pos"), "entry_name", "size", F.col("crc").alias("hash"), "md5", "sha1")
    )
    members = cut(IN.list_members(files))
    good = members.filter("error IS NULL")
    primary = ME.primary_members(good, D.accepted_types(F.col("collection"))).select(*FILE, "member_name")
    variants = cut(IN.streamed_variants(files.join(primary, FILE, "left")))
    problems = CA.rejected_catalogs(spark, catalogs).select(F.col("catalog_path").alias("path"), "error").unionByName(
        variants.filter("error IS NOT NULL").join(files, FILE).select("path", "error"))
    return Shelf(cut(entries), files, members, variants, problems)


def scan(shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(sets with their status, files no catalogue wants with the closest set name)."""
    results = reconcile.entry_results(shelf.entries, shelf.hashes)
    unmatched = reconcile.unmatched_files(shelf.hashes, shelf.entries)
    return reconcile.set_results(results), closest_sets(unmatched, shelf.sets)


def check_names(shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(rating of every catalogue, rows by name alone), without opening a file."""
    pairs = cut(PC.pair_by_name(shelf.files, shelf.sets))
    return PC.rate(PC.profile(shelf.files, shelf.entries, pairs)), PC.result_rows(shelf.files, shelf.sets, pairs)


def analyse(shelf: Shelf, *more: DataFrame) -> DataFrame:
    """The best set of every file over all catalogues of its collection."""
    found = candidates.gather(shelf.files.select(*FILE), shelf.variants.filter("error IS NULL"), shelf.entries, *more)
    return candidates.best_per_file(found)


def export(shelf: Shelf, best: DataFrame, dest: str, **options) -> DataFrame:
    """Write every confirmed file under the name its set asks for; returns the manifest."""
    raw = shelf.variants.filter("kind = 'raw'").select(*FILE, "size", "order_found", F.col("error").isNull().alias("readable"))
    zeros = shelf.variants.filter("kind = 'prefix'").groupBy(*FILE).agg(
        F.map_from_entries(F.collect_list(F.struct("prefix", "zero_pct"))).alias("zero_pct"))
    first = shelf.entries.groupBy("collection", "catalog", "set_pos").agg(F.min_by("entry_name", "entry_pos").alias("entry_name"))
    inner = ME.primary_members(shelf.members.filter("error IS NULL"), D.accepted_types(F.col("collection"))).select(*FILE, "member_name")
    jobs = (
        best.filter("status = 'matched'").join(first, ["collection", "catalog", "set_pos"], "left").join(raw, FILE).join(zeros, FILE, "left").join(inner, FILE, "left")
        .select("collection", "catalog", "file_name", "set_name", "entry_name", N.extension(F.coalesce("member_name", "file_name")).alias("source_type"),
                "size", "order_found", F.coalesce("zero_pct", F.create_map().cast("map<int,int>")).alias("zero_pct"), "readable")
    )
    jobs = cut(jobs)
    good = shelf.members.filter("error IS NULL")
    headers, steps = rules.plan_headers(jobs, good), rules.plan_steps(jobs, good)
    located = shelf.files.select(*FILE, F.col("path").alias("source_path"))
    return writer.write_exports(writer.export_jobs(headers, steps, located), dest, **options)
