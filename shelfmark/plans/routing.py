"""Which requested files are exported, and why the others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.regions import region_exclusions

FILE = ["collection", "file_name"]
WHY = {
    "unmatched": "no CRC match in DAT (fan translation, hack, or bad dump)",
    "unverified": "run Analyze first",
    "ok": "run Analyze first",
}


def _known_rows(results: DataFrame) -> DataFrame:
    """First row and first matched row of every file."""
    is_matched = F.col("status") == "matched"
    return (
        results.filter(F.col("file_name").isNotNull()).groupBy(*FILE).agg(
            F.min_by(F.struct("status", "plan"), "row_pos").alias("any_row"),
            F.min_by(F.struct("set_name", "plan"), F.when(is_matched, F.col("row_pos"))).alias("matched_row"),
            F.bool_or(is_matched).alias("is_matched"),
        )
    )


def route(requested: DataFrame, results: DataFrame, on_disk: DataFrame, preferences: list[str]) -> DataFrame:
    """Outcome (export, excluded, duplicate, failed) and reason per requested file.

    ``requested``: collection, file_name. ``on_disk``: the same, files that exist.
    """
    rows = requested.select(*FILE).distinct().join(_known_rows(results), FILE, "left")
    named = rows.filter("is_matched").select(*FILE, F.col("matched_row.set_name").alias("set_name"))
    regional = region_exclusions(named, preferences).filter("excluded").select(*FILE, F.lit(True).alias("off_region"))
    present = on_disk.select(*FILE).distinct().withColumn("present", F.lit(True))
    joined = rows.join(regional, FILE, "left").join(present, FILE, "left")

    matched = F.coalesce("is_matched", F.lit(False))
    status, plan = F.col("any_row.status"), F.col("any_row.plan")
    why = F
    for name, text in WHY.items():
        why = why.when(status == name, text)
    why = F.concat(F.lit("Skipped ("), why.otherwise(F.concat(F.lit("status: "), status)), F.lit(")"))
    region_text = f"Region-excluded (prefer {', '.join(preferences)})"
    rules = [
        (F.coalesce("off_region", F.lit(False)), "excluded", F.lit(region_text)),
        (~matched & F.col("any_row").isNull(), "failed", F.lit("Not in database — run Scan first")),
        (~matched & (plan == "exclude"), "excluded", F.lit("Excluded")),
        (~matched & (status == "duplicate"), "duplicate", F.lit("Skipped (duplicate)")),
        (~matched, "failed", why),
        (F.col("matched_row.plan") == "exclude", "excluded", F.lit("Excluded")),
        (F.col("present").isNull(), "failed", F.lit("File not found on disk")),
        (F.lit(True), "export", F.lit("")),
    ]
    outcome = reason = F
    for applies, name, text in rules:
        outcome, reason = outcome.when(applies, name), reason.when(applies, text)
    return joined.select(
        *FILE, F.col("matched_row.set_name").alias("set_name"), outcome.alias("outcome"), reason.alias("reason"))


def outcome_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("collection", "outcome").agg(F.count(F.lit(1)).alias("n_files"))
