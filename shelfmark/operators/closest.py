"""Closest set name for files nothing matched, with the reason.

Names are compared as sets of letters and digits (36-bit masks): shared / larger > 0.7, best one
wins, first set on ties. Instead of comparing masks pairwise, both sides list what is left after
taking one letter away, then two, and meet on an equal remainder. For such a meeting the score
depends only on how many letters each side lost, so the catalogue keeps one set per (remainder,
letters lost) and nothing is paired up. A file that finds nothing that near is looked up again
through subsets of its rarest letters, which finds every mask above the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.operators.reconcile import SCOPE
from shelfmark.session import cut, spread

NOTHING = "No similar DAT entry found"
THRESHOLD = 0.7


def _bits(mask: Column) -> Column:
    """Single-bit masks of the letters in a mask, rarest first."""
    every = F.array(*[F.lit(1 << i).cast("bigint") for i in range(len(N.MASK_LETTERS))])
    return F.filter(every, lambda b: mask.bitwiseAND(b) != 0)


def _remainders(df: DataFrame, keep: list[str], depth: int) -> DataFrame:
    """Rows (keep, core, lost) for every way to take up to ``depth`` (1 or 2) letters away."""
    mask, bits = F.col("mask"), F.col("bits")

    def core(value, lost):
        return F.struct(value.alias("core"), F.lit(lost).alias("lost"))

    cores = [F.array(core(mask, 0)), F.transform(bits, lambda a: core(mask.bitwiseXOR(a), 1))]
    if depth == 2:
        cores.append(F.flatten(F.transform(bits, lambda a: F.transform(
            F.filter(bits, lambda b: b > a), lambda b: core(mask.bitwiseXOR(a).bitwiseXOR(b), 2)))))
    return (
        df.withColumn("bits", _bits(mask)).select(*keep, F.explode(F.concat(*cores)).alias("c"))
        .select(*keep, "c.*").filter(F.col("core") != 0)
    )


def _rare_keys(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, key): four-letter subsets of the letters that may hold the first four shared ones.

    Two masks above the threshold share at least floor(0.7 n) + 1 letters of the one with n, so the
    first four shared letters lie among its n - floor(0.7 n) + 3 rarest ones.
    """
    n = F.size("bits")
    front = F.slice("bits", 1, (n - F.floor(n * 7 / 10) + 3).cast("int"))
    p = F.col("front")
    after = lambda x: F.filter(p, lambda y: y > x)
    keys = F.flatten(F.transform(p, lambda a: F.flatten(F.transform(after(a), lambda b: F.flatten(
        F.transform(after(b), lambda c: F.transform(
            after(c), lambda d: a.bitwiseOR(b).bitwiseOR(c).bitwiseOR(d)))
    )))))
    return (
        df.withColumn("bits", _bits(F.col("mask"))).withColumn("front", front)
        .select(*keep, F.explode(keys).alias("key"))
    )


def _winners(scored: DataFrame) -> DataFrame:
    """Best score per mask and the first set that has it; numbers only, so both steps hash."""
    first = scored.filter(F.col("score") > THRESHOLD).groupBy(*SCOPE, "mask", "score").agg(F.min("set_pos").alias("set_pos"))
    return first.groupBy(*SCOPE, "mask").agg(F.max_by("set_pos", "score").alias("set_pos"), F.max("score").alias("score"))


def nearest_masks(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Best set per asked mask. ``asked``: SCOPE, mask; ``listed``: SCOPE, mask, set_pos, set_name.

    Both distinct by (SCOPE, mask), and best written tables. Returns SCOPE, mask, set_name, score; no
    row when nothing is near.

    With n letters, whatever is found within t letters scores at least (n - t)/n and whatever is
    farther at most n/(n + t + 1). The first is larger when n > t(t + 1), and for shorter names the
    second does not pass the threshold. So a mask that found something is done, and only the others
    go on to the next, wider step.
    """
    found, rest = None, asked
    for depth, shortest in ((1, 5), (2, 8)):
        others = listed if found is None else _same_catalogs(listed, rest)
        here = _remainders(spread(rest, *SCOPE, "mask"), [*SCOPE, "mask"], depth)
        there = (
            _remainders(spread(others, *SCOPE, "mask"), [*SCOPE, "set_pos"], depth)
            .groupBy(*SCOPE, "core", F.col("lost").alias("lost_there"))
            .agg(F.min("set_pos").alias("set_pos"))
        )
        shared = F.bit_count("core")
        score = shared / (shared + F.greatest("lost", "lost_there"))
        hits = cut(_winners(here.join(there, [*SCOPE, "core"]).withColumn("score", score)))
        found = hits if found is None else found.unionByName(hits)
        rest = rest.join(hits, [*SCOPE, "mask"], "left_anti").filter(F.bit_count("mask") >= shortest)
        if rest.isEmpty():
            break
    else:
        others = _same_catalogs(listed, rest).filter(F.bit_count("mask") > 5)
        pairs = _rare_keys(spread(rest, *SCOPE, "mask"), [*SCOPE, "mask"]).join(
            _rare_keys(spread(others, *SCOPE, "mask"), [*SCOPE, "set_pos", "mask"]).withColumnRenamed("mask", "other"),
            [*SCOPE, "key"],
        )
        both = F.bit_count(F.col("mask").bitwiseAND(F.col("other")))
        larger = F.greatest(F.bit_count("mask"), F.bit_count("other"))
        found = found.unionByName(_winners(pairs.withColumn("score", both / larger)))
    return found.join(listed.select(*SCOPE, "set_pos", "set_name"), [*SCOPE, "set_pos"]).select(
        *SCOPE, "mask", "set_name", "score")


def _same_catalogs(listed: DataFrame, rest: DataFrame) -> DataFrame:
    return listed.join(rest.select(*SCOPE).distinct(), SCOPE, "left_semi")


def extra_tags(left: Column, right: Column) -> Column:
    """Sorted tags only the left side has, as text."""
    return F.array_join(F.array_sort(F.array_except(left, right)), ", ")


def tag_note(set_name: Column, file_tags: Column, set_tags: Column) -> Column:
    """Why two names with one base still differ: tags only one of them has."""

    def listing(prefix, extra):
        return F.when(extra != "", F.concat(F.lit(prefix), extra))

    parts = F.concat_ws(
        "; ", listing("ROM has: ", extra_tags(file_tags, set_tags)), listing("DAT has: ", extra_tags(set_tags, file_tags)))
    return F.concat(
        F.lit("Similar: "), set_name, F.lit(" — "),
        F.when(parts == "", "Different naming convention").otherwise(parts),
    )


def closest_sets(files: DataFrame, sets: DataFrame) -> DataFrame:
    """``files``: SCOPE, file_name. ``sets``: SCOPE, set_pos, set_name. Adds closest_set and note."""
    asked = files.select(*SCOPE, "file_name", N.stem(F.col("file_name")).alias("stem")).withColumns({
        "clean": N.clean_base(F.col("stem")),
        "norm": N.normalize_name(F.col("stem")),
    }).withColumn("mask", N.char_mask(F.col("norm"))).drop("norm")
    by_base = (
        sets.withColumn("clean", N.clean_base(F.col("set_name"))).filter(F.col("clean") != "")
        .groupBy(*SCOPE, "clean").agg(F.min(F.struct("set_pos", "set_name")).alias("s"))
        .select(*SCOPE, "clean", F.col("s.set_name").alias("same_base"))
    )
    by_mask = (
        sets.withColumn("norm", N.normalize_name(F.col("set_name")))
        .withColumn("mask", N.char_mask(F.col("norm"))).filter(F.col("mask") != 0)
        .groupBy(*SCOPE, "mask").agg(F.min(F.struct("set_pos", "set_name")).alias("s"))
        .select(*SCOPE, "mask", "s.*")
    )
    based = cut(asked.join(by_base, [*SCOPE, "clean"], "left"))
    masks = based.filter(F.col("same_base").isNull() & (F.col("mask") != 0)).select(*SCOPE, "mask").distinct()
    near = nearest_masks(cut(masks), cut(by_mask)).select(*SCOPE, "mask", F.col("set_name").alias("near"))
    note = (
        F.when(F.col("same_base").isNotNull(), tag_note(
            F.col("same_base"), N.extract_tags(F.col("stem")), N.extract_tags(F.col("same_base"))))
        .when(F.col("near").isNotNull(), F.concat(F.lit("Similar: "), "near"))
        .otherwise(NOTHING)
    )
    return based.join(near, [*SCOPE, "mask"], "left").select(
        *SCOPE, "file_name", F.coalesce("same_base", "near").alias("closest_set"), note.alias("note")
    )
