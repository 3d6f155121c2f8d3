"""Name candidates: full names, region-expanded names, equal bases and word containment.

Containment would be a comparison of every file with every set. Here the longer side lists its
word-bounded substrings once and the shorter side is joined to them by equality, so the work is
linear in the two name lists whatever the names are.

``files``  collection, file_name        ``sets``  collection, catalog, set_pos, set_name, first_hash
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.operators.reconcile import SCOPE
from shelfmark.session import cut, spread

TOP = 5
# sets that full-name rules name for a file, at most
NAMED = 5


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per set name: first position, and the first-entry hash of its first and last mention."""
    return sets.groupBy(*SCOPE, "set_name").agg(
        F.min("set_pos").alias("set_pos"),
        F.min_by("first_hash", "set_pos").alias("first_hash"),
        F.max_by("first_hash", "set_pos").alias("last_hash"),
    )


def stems(files: DataFrame) -> DataFrame:
    stem = N.stem(F.col("file_name"))
    return (
        files.select("collection", stem.alias("stem")).distinct()
        .withColumn("base", N.extract_base(F.col("stem")))
        .filter(F.length("base") >= 3)
        .withColumn("base_key", F.lower("base"))
    )


def full_name_candidates(stem_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Equality of whole names, in rule order; the last set wins among names that differ by case."""
    stem_rows = stem_rows.withColumn("expanded", N.expand_regions(F.col("stem"))).withColumn(
        "cleaned", N.drop_square_tags(F.col("expanded")))
    expanded, cleaned = F.col("expanded"), F.col("cleaned")
    changed = expanded != F.col("stem")

    def rule(ord_, form, key, confidence, when=None):
        row = F.struct(
            F.lit(ord_).alias("rule_ord"), F.lit(form).alias("form"), key.alias("key"),
            F.lit(confidence).alias("confidence"),
        )
        return row if when is None else F.when(when, row)

    rules = F.array(
        rule(1, "lower", F.lower("stem"), 0.95),
        rule(2, "lower", F.lower(cleaned), 0.95),
        rule(3, "exact", expanded, 0.9, changed),
        rule(4, "exact", cleaned, 0.9, changed),
        rule(5, "lower", F.lower(expanded), 0.85, changed),
        rule(6, "lower", F.lower(cleaned), 0.85, changed),
    )
    asked = stem_rows.select(
        "collection", "stem", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")
    ).select("collection", "stem", "r.*")
    exact = sets.select(
        *SCOPE, F.lit("exact").alias("form"), F.col("set_name").alias("key"), "set_name", "set_pos",
        F.col("last_hash").alias("expected_hash"),
    )
    lower = sets.groupBy(*SCOPE, F.lower("set_name").alias("key")).agg(
        F.max_by(F.struct("set_name", "set_pos", F.col("last_hash").alias("expected_hash")), "set_pos").alias("s")
    ).select(*SCOPE, F.lit("lower").alias("form"), "key", "s.*")
    targets = exact.unionByName(lower)
    text = (
        F.when(F.col("rule_ord") <= 2, F.concat(F.lit('Exact name match: "'), "set_name", F.lit('"')))
        .when(F.col("rule_ord") <= 4, F.concat(F.lit("Region expanded: "), "stem", F.lit(" → "), "set_name"))
        .otherwise(F.concat(F.lit("Region expanded (case-insensitive): "), "stem", F.lit(" → "), "set_name"))
    )
    return asked.join(targets, ["collection", "form", "key"]).select(
        *SCOPE, "stem", "set_name", "set_pos", "expected_hash", "confidence", "rule_ord", text.alias("reason")
    )


def _best(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First ``n`` rows per key by confidence. Spark cuts each group before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "set_pos")
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def base_candidates(bases: DataFrame, sets: DataFrame, best: int | None = None) -> DataFrame:
    """Sets whose base equals, contains or is contained in a file base: all, or the ``best`` per base.

    ``bases``: collection, base_key (distinct). ``sets``: see ``distinct_sets``, a row a position. Returns SCOPE, base_key, how, set_*, confidence.
    """
    def few(df: DataFrame, keys: list[str]) -> DataFrame:
        return df if best is None else _best(df, keys, best)

    named = sets.select(
        *SCOPE, "set_name", "set_pos", F.col("first_hash").alias("expected_hash"),
        F.lower(N.extract_base(F.col("set_name"))).alias("set_base"),
    ).filter(F.col("set_base") != "")

    # a set base lists its windows, numbers beside them; only those that are a file base meet the set's names again
    windows = (
        named.select(*SCOPE, "set_pos", F.explode(N.word_windows(F.col("set_base"))).alias("base_key"))
        .join(bases, ["collection", "base_key"], "left_semi").join(named, [*SCOPE, "set_pos"])
    )
    equal = F.col("base_key") == F.col("set_base")
    share = F.length("base_key") / F.length("set_base")
    forward = few(windows.select(
        *SCOPE, "base_key", "set_name", "set_pos", "expected_hash",
        F.when(equal, "equal").otherwise("inside").alias("how"),
        F.when(equal, 0.85).otherwise(F.least(F.lit(0.7), share)).alias("confidence"),
    ), [*SCOPE, "base_key"])

    # a file base lists its windows; they are looked up among the set bases
    first = few(
        named.select(*SCOPE, "set_base", "set_name", "set_pos", "expected_hash", F.lit(0.0).alias("confidence")),
        [*SCOPE, "set_base"],
    ).drop("confidence")
    parts = spread(bases, "collection", "base_key").select(
        "collection", "base_key", F.explode(N.word_windows(F.col("base_key"))).alias("set_base")
    ).filter(F.col("set_base") != F.col("base_key"))
    backward = parts.join(first, ["collection", "set_base"]).select(
        *SCOPE, "base_key", "set_name", "set_pos", "expected_hash", F.lit("around").alias("how"),
        F.least(F.lit(0.5), F.length("set_base") / F.length("base_key")).alias("confidence"),
    )
    return few(forward.unionByName(backward), [*SCOPE, "base_key"])


def name_candidates(files: DataFrame, sets: DataFrame, top: int = TOP) -> DataFrame:
    """Best ``top`` sets per (catalogue, file stem); a set keeps the first rule that names it."""
    # both are read by several joins: a table each instead of their whole plan again
    known, stem_rows = cut(distinct_sets(sets)), cut(stems(files))
    by_name = full_name_candidates(stem_rows, known)
    # the best top + NAMED by base contain the top that remain once the named sets are taken out
    by_base = base_candidates(stem_rows.select("collection", "base_key").distinct(), known, top + NAMED)
    text = (
        F.when(F.col("how") == "equal", F.concat(F.lit('Exact base name match: "'), "base", F.lit('"')))
        .when(F.col("how") == "inside",
              F.concat(F.lit('ROM name "'), "base", F.lit('" found in "'), "set_name", F.lit('"')))
        .otherwise(F.concat(F.lit('DAT name "'), "set_name", F.lit('" found in ROM name "'), "base", F.lit('"')))
    )
    by_words = stem_rows.join(by_base, ["collection", "base_key"]).select(
        *SCOPE, "stem", "set_name", "set_pos", "expected_hash", "confidence",
        F.lit(7).alias("rule_ord"), text.alias("reason"),
    )
    # a bounded number of rows per stem from here on: one exchange serves both windows
    rows = by_name.unionByName(by_words).repartition(*SCOPE, "stem")
    once = Window.partitionBy(*SCOPE, "stem", "set_name").orderBy("rule_ord")
    rank = Window.partitionBy(*SCOPE, "stem").orderBy(F.desc("confidence"), "rule_ord", "set_pos")
    return (
        rows.withColumn("_rn", F.row_number().over(once)).filter("_rn = 1").drop("_rn")
        .withColumn("name_rank", F.row_number().over(rank)).filter(F.col("name_rank") <= top)
    )
