"""Settle result rows after matching: one row per matched file, one keeper per set, stale variants out.

``results``  collection, row_pos, set_name, description, file_name, status, note, plan,
             expected_file_name
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names as N

FILE = ["collection", "file_name"]


def apply_matches(results: DataFrame, matches: DataFrame) -> DataFrame:
    """First row of a matched file takes the match, its other rows go; all else stays.

    ``matches``: collection, file_name, matched_set, reason, plan_label (one row per file).
    """
    cols = results.columns
    # rows of missing sets have no file: they would all meet in one join partition
    fileless = results.filter(F.col("file_name").isNull())
    filed = results.filter(F.col("file_name").isNotNull())
    hit = (
        filed.join(matches.select(*FILE), FILE, "left_semi")
        .groupBy(*FILE).agg(F.min_by(F.struct(*cols), "row_pos").alias("r")).select("r.*")
        .join(matches, FILE)
        .withColumns({
            "status": F.lit("matched"), "note": F.col("reason"), "plan": F.col("plan_label"),
            "set_name": F.col("matched_set"), "description": F.col("matched_set"),
            "expected_file_name": N.package_name(F.col("matched_set")),
        }).select(*cols)
    )
    rest = filed.join(matches.select(*FILE), FILE, "left_anti")
    return hit.unionByName(rest.select(*cols)).unionByName(fileless)


def mark_duplicates(results: DataFrame) -> DataFrame:
    """Of several files matched to one set keep the one needing no change, then the first by name."""
    matched = results.filter(F.col("status") == "matched")
    worse = F.when(F.col("plan") == "ok", 0).otherwise(1)
    keepers = matched.groupBy("collection", "set_name").agg(
        F.min(F.struct(worse.alias("worse"), F.col("file_name").alias("keeper"))).alias("k")
    ).select("collection", "set_name", "k.keeper")
    lost = F.col("keeper") != F.col("file_name")
    settled = matched.join(keepers, ["collection", "set_name"]).withColumns({
        "status": F.when(lost, "duplicate").otherwise(F.col("status")),
        "note": F.when(lost, F.concat(F.lit("Duplicate of "), "keeper")).otherwise(F.col("note")),
        "plan": F.when(lost, "").otherwise(F.col("plan")),
    })
    others = results.filter(~F.col("status").eqNullSafe("matched"))
    return settled.select(*results.columns).unionByName(others)


def drop_stale_variants(results: DataFrame) -> DataFrame:
    """Remove unverified rows of a set, or file, another row already matched."""
    matched = results.filter(F.col("status") == "matched")
    bases = matched.select("collection", N.variant_base(F.col("set_name")).alias("_base")).distinct()
    files = matched.filter(F.col("file_name").isNotNull()).select(*FILE).distinct()
    open_rows = results.filter(F.col("status") == "unverified").withColumn("_base", N.variant_base(F.col("set_name")))
    kept = open_rows.join(bases, ["collection", "_base"], "left_anti").join(files, FILE, "left_anti")
    others = results.filter(~F.col("status").eqNullSafe("unverified"))
    return kept.select(*results.columns).unionByName(others)


def set_plan(results: DataFrame, files: DataFrame, plan: str) -> DataFrame:
    """Set ``plan`` for the given files (collection, file_name)."""
    named = files.select(*FILE).distinct().withColumn("_set", F.lit(plan))
    return results.join(named, FILE, "left").withColumn("plan", F.coalesce("_set", "plan")).drop("_set")


def mark_errors(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of files whose analysis failed. ``errors``: collection, file_name, error."""
    failed = errors.groupBy(*FILE).agg(F.min("error").alias("_error"))
    bad = F.col("_error").isNotNull()
    return results.join(failed, FILE, "left").withColumns({
        "status": F.when(bad, "error").otherwise(F.col("status")),
        "note": F.when(bad, F.col("_error")).otherwise(F.col("note")),
    }).drop("_error")


def plan_label(n_steps):
    return F.when(n_steps > 0, "modify").otherwise("ok")
