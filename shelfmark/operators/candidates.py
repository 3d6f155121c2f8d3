"""From single candidates to the best answer per file.

Stages: content hash, stripped prefix, byte order, names. A set keeps the first stage that names
it, and names are only asked about files no content rule has confirmed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.operators import hash_match, name_match
from shelfmark.operators.reconcile import SCOPE, _usable, wanted_hashes, with_catalogs
from shelfmark.session import cut

FIELDS = ["set_name", "set_pos", "n_sets", "confidence", "reason", "expected_hash", "actual_hash",
          "hash_match", "action", "stage", "rule_ord", "content_key"]


def confirmed(c: Column | str = "hash_match") -> Column:
    """Three-valued: NULL means not checked and is not a confirmation."""
    return (F.col(c) if isinstance(c, str) else c).eqNullSafe(F.lit(True))


def _first_sets(entries: DataFrame, key: str) -> DataFrame:
    """One row per (catalogue, hash or size): its first set and how many sets share it."""
    usable = _usable("hash") if key == "hash" else F.col("size") > 0
    value = F.lower("hash") if key == "hash" else F.col("size")
    return (
        entries.filter(usable).groupBy(*SCOPE, value.alias(key))
        .agg(F.min(F.struct("set_pos", "set_name")).alias("s"), F.count_distinct("set_pos").alias("n_sets"))
        .select(*SCOPE, key, "s.*", "n_sets")
    )


def prefix_reason(label: Column, prefix: Column, zero_pct: Column) -> Column:
    return F.concat(
        F.lit("Header detected: "), label, F.lit(" ("), prefix.cast("string"), F.lit(" bytes, "),
        zero_pct.cast("string"), F.lit("% zeros). CRC after stripping header matches DAT entry."),
    )


def size_reason(label: Column, prefix: Column, size: Column) -> Column:
    return F.concat(
        F.lit("Possible "), label, F.lit(" ("), prefix.cast("string"), F.lit(" bytes). Size after stripping ("),
        size.cast("string"), F.lit(") matches DAT, but CRC still differs."),
    )


def content_candidates(variants: DataFrame, entries: DataFrame) -> DataFrame:
    """Per file and catalogue, what each reading of the content finds: its first set and the number of sets.

    All sets of a content are in ``hash_match.content_sets``, under the candidate's ``content_key``;
    repeating them for every copy would multiply two hot groups.
    """
    raw = variants.filter(F.col("kind") == "raw").select("collection", "file_name", F.col("hash").alias("raw_hash"))
    hits = variants.filter(_usable()).join(_first_sets(entries, "hash"), ["collection", "hash"])
    stage = F.when(F.col("kind") == "raw", 1).when(F.col("kind") == "prefix", 2).otherwise(3)
    by_hash = hits.join(raw, ["collection", "file_name"]).select(
        *SCOPE, "file_name", "set_name", "set_pos", "n_sets",
        F.when(F.col("kind") == "prefix", 0.95).otherwise(1.0).alias("confidence"),
        F.when(F.col("kind") == "raw", "Direct CRC match")
        .when(F.col("kind") == "prefix", prefix_reason(F.col("label"), F.col("prefix"), F.col("zero_pct")))
        .otherwise(F.concat(F.lit("Content matches after byte-order change: "), "label")).alias("reason"),
        F.col("hash").alias("expected_hash"), F.col("raw_hash").alias("actual_hash"),
        F.lit(True).alias("hash_match"), F.lit("rename").alias("action"),
        stage.alias("stage"), F.col("variant_ord").cast("int").alias("rule_ord"),
        F.concat(F.lit("hash:"), "hash").alias("content_key"),
    )
    firsts = hash_match.first_hashes(entries).select(*SCOPE, "set_pos", "first_hash")
    misses = hash_match.prefix_misses(variants, entries)
    by_size = (
        misses.join(_first_sets(entries, "size"), [*SCOPE, "size"])
        .join(firsts, [*SCOPE, "set_pos"])
        .select(
            *SCOPE, "file_name", "set_name", "set_pos", "n_sets", F.lit(0.3).alias("confidence"),
            size_reason(F.col("label"), F.col("prefix"), F.col("size")).alias("reason"),
            F.col("first_hash").alias("expected_hash"), F.col("hash").alias("actual_hash"),
            F.lit(False).alias("hash_match"), F.lit("crc_mismatch").alias("action"),
            F.lit(2).alias("stage"), F.col("variant_ord").cast("int").alias("rule_ord"),
            F.concat(F.lit("size:"), F.col("size").cast("string")).alias("content_key"),
        )
    )
    return by_hash.unionByName(by_size)


def verify_names(named: DataFrame, variants: DataFrame) -> DataFrame:
    """Check name candidates against the readings of the file.

    ``named``: SCOPE, file_name, set_name, expected_hash, confidence, reason, ...
    Raw hash equal: certain. A stripped or swapped reading equal: 0.95. Otherwise a mismatch;
    nothing expected: stays unchecked.
    """
    raw = variants.filter((F.col("kind") == "raw") & _usable()).select(
        "collection", "file_name", F.col("hash").alias("raw_hash"))
    said = F.when(F.col("kind") == "swap", F.concat(F.lit("N64 treated as "), "label", F.lit(" → BigEndian conversion")))
    other = (
        variants.filter(F.col("kind") != "raw").withColumn("label", said.otherwise(F.col("label")))
        .groupBy("collection", "file_name", F.col("hash").alias("expected_hash"))
        # of several prefixes with one hash the last one names it; a swap never replaces a prefix
        .agg(F.max_by("label", F.when(F.col("kind") == "prefix", F.col("variant_ord")).otherwise(-F.col("variant_ord"))).alias("other_label"))
    )
    joined = (
        named.withColumn("expected_hash", F.lower("expected_hash"))
        .join(raw, ["collection", "file_name"], "left")
        .join(other, ["collection", "file_name", "expected_hash"], "left")
    )
    checked = F.col("raw_hash").isNotNull() & _usable("expected_hash")
    same = checked & (F.col("raw_hash") == F.col("expected_hash"))
    near = checked & F.col("other_label").isNotNull()
    return joined.select(
        *SCOPE, "file_name", "set_name", "set_pos",
        F.when(same, 1.0).when(near, 0.95).otherwise(F.col("confidence")).alias("confidence"),
        F.when(~same & near, F.concat("reason", F.lit(" (after stripping "), "other_label", F.lit(" header)")))
        .otherwise(F.col("reason")).alias("reason"),
        "expected_hash",
        F.when(~same & near, F.col("expected_hash")).otherwise(F.col("raw_hash")).alias("actual_hash"),
        F.when(same | near, True).when(checked, False).alias("hash_match"),
        F.when(same | near, "rename").when(checked, "crc_mismatch").alias("action"),
        "rule_ord",
    )


Rule = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def run_rules(rules: dict[str, Rule], files: DataFrame, variants: DataFrame, entries: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """What further rules find, and (rule, error) of those that fail; one that fails leaves the others as they are.

    A rule is a function of files, variants and entries that gives candidates in the columns of ``content_candidates`` (those
    it leaves out are NULL). It is run here, by itself: an error in one of its rows is the rule's error, not the caller's.
    """
    found, failed = [], []
    for name, rule in rules.items():
        try:
            found.append(cut(rule(files, variants, entries)))
        except Exception as exc:  # a rule may fail in any way
            failed.append((name, f"Analyzer '{name}' failed: {str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__}"))
    return found, files.sparkSession.createDataFrame(failed, "rule string, error string")


def gather(files: DataFrame, variants: DataFrame, entries: DataFrame, *more: DataFrame) -> DataFrame:
    """All candidates per file and catalogue, each set once, the name stage only where it is needed.

    ``more``: content candidates of further rules, in the columns of ``content_candidates`` (see ``run_rules``). What
    several later steps read is written out once instead of being joined together again for each.
    """
    content = content_candidates(variants, entries)
    for extra in more:
        content = content.unionByName(extra, allowMissingColumns=True)
    content = cut(content)
    sure = content.filter(confirmed()).select(*SCOPE, "file_name").distinct()
    # names are asked for files that some catalogue of the collection leaves open
    asked = (
        with_catalogs(files.select("collection", "file_name"), entries)
        .join(sure, [*SCOPE, "file_name"], "left_anti").select("collection", "file_name").distinct()
    )
    asked = cut(asked)
    named = name_match.name_candidates(asked, hash_match.first_hashes(entries))
    open_names = cut(
        asked.select("collection", "file_name", N.stem(F.col("file_name")).alias("stem"))
        .join(named, ["collection", "stem"]).drop("stem")
        .join(sure, [*SCOPE, "file_name"], "left_anti")
    )
    # a set some stripped length already named is not named again
    sizes = entries.filter(F.col("size") > 0).select(*SCOPE, "set_name", "size").distinct()
    stripped = variants.filter(F.col("kind") == "prefix").select("collection", "file_name", "size", "hash")
    blocked = (
        open_names.select(*SCOPE, "file_name", "set_name").join(sizes, [*SCOPE, "set_name"])
        .join(stripped, ["collection", "file_name", "size"])
        .join(wanted_hashes(entries), [*SCOPE, "hash"], "left_anti")
        .select(*SCOPE, "file_name", "set_name").distinct()
    )
    fresh = verify_names(open_names.join(blocked, [*SCOPE, "file_name", "set_name"], "left_anti"), variants)
    fresh = fresh.withColumns({"stage": F.lit(4), "n_sets": F.lit(1).cast("bigint"), "content_key": F.lit(None).cast("string")})
    # at most a dozen rows per file and catalogue
    once = Window.partitionBy(*SCOPE, "file_name", "set_name").orderBy("stage", "rule_ord")
    rows = content.unionByName(fresh.select(*content.columns)).repartition(*SCOPE, "file_name")
    return rows.withColumn("_rn", F.row_number().over(once)).filter("_rn = 1").drop("_rn")


def rank(candidates: DataFrame) -> DataFrame:
    """Confirmed first, then by confidence, then in the order they were found."""
    order = Window.partitionBy(*SCOPE, "file_name").orderBy(
        F.desc(confirmed()), F.desc("confidence"), "stage", "rule_ord", "set_pos")
    return candidates.withColumn("candidate_rank", F.row_number().over(order))


def best_per_file(candidates: DataFrame, legacy_order: bool = False) -> DataFrame:
    """Best candidate over all catalogues of the collection, in catalogue order on ties.

    With ``legacy_order`` confidence alone decides, so an unconfirmed one may win a tie.
    """
    lead = [] if legacy_order else [confirmed()]
    within = [F.when(confirmed(), 0).otherwise(1)]
    order = F.struct(
        *[F.when(x, 0).otherwise(1) for x in lead], -F.col("confidence"), F.col("catalog"), *within,
        F.col("stage"), F.col("rule_ord"), F.col("set_pos"),
    )
    pick = F.struct("catalog", *FIELDS)
    best = candidates.groupBy("collection", "file_name").agg(F.min_by(pick, order).alias("b"))
    return best.select("collection", "file_name", "b.*").withColumn(
        "status", F.when(confirmed(), "matched"))
