import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.operators import candidates as C
from shelfmark.operators import closest as CL
from shelfmark.operators import collections as CO
from shelfmark.operators import hash_match as H
from shelfmark.operators import name_match as M
from shelfmark.operators import precheck as P
from shelfmark.operators import ranking as RK
from shelfmark.operators import reconcile as R
from workload.frames import PAIRS

FILES = "collection string, file_name string"
SETS = "collection string, catalog string, set_pos bigint, set_name string, first_hash string"


def names_for(spark, stem, sets):
    files = spark.createDataFrame([("c", stem + ".zip")], FILES)
    rows = spark.createDataFrame([("c", "k", i, s, f"h{i}") for i, s in enumerate(sets)], SETS)
    return M.name_candidates(files, rows).orderBy("name_rank").collect()


@pytest.mark.parametrize("stem, sets, first, low, high", [
    ("WWF No Mercy (USA) (Rev 1)", ["WWF No Mercy (USA) (Rev 1)"], "WWF No Mercy (USA) (Rev 1)", 0.95, 0.95),
    ("Tetris", ["Tetris (USA)"], "Tetris (USA)", 0.85, 1),
    ("Spawn (U)", ["Spawn (USA)", "Todd McFarlane's Spawn - The Video Game (USA)"], "Spawn (USA)", 0.95, 0.95),
    ("Spawn (U)", ["Todd McFarlane's Spawn - The Video Game (USA)"], "Todd McFarlane's Spawn - The Video Game (USA)", 0.01, 0.9),
    ("Super Tetris Challenge (USA)", ["Tetris (USA)"], "Tetris (USA)", 0.01, 0.5),
    ("EA (U)", ["EA Sports (USA)"], None, 0, 0),
    ("Zelda (U)", ["Super Mario Bros (USA)"], None, 0, 0),
])
def test_name_candidates(spark, stem, sets, first, low, high):
    got = names_for(spark, stem, sets)
    if first is None:
        assert got == []
    else:
        assert got[0].set_name == first and low <= got[0].confidence <= high


ENTRY = "collection string, catalog string, set_pos bigint, set_name string, entry_pos int, entry_name string, size bigint, hash string"
VARIANT = ("collection string, file_name string, kind string, prefix int, label string, order_found string, hash string, size bigint, "
           "variant_ord int, zero_pct int")


def test_every_set_of_a_content(spark):
    entries = spark.createDataFrame([("c", "k", i, f"s{i}", 0, "e.bin", 7, "aa" if i < 3 else "bb") for i in range(4)], ENTRY)
    variants = spark.createDataFrame([("c", f"f{i}.bin", "raw", None, None, None, "AA".lower(), 7, 0, None) for i in range(2)], VARIANT)
    files = variants.select("collection", "file_name")
    rows = C.gather(files, variants, entries)
    assert {(r.file_name, r.set_name, r.n_sets, r.content_key) for r in rows.collect()} == {(f"f{i}.bin", "s0", 3, "hash:aa") for i in range(2)}
    every = rows.select("collection", "catalog", "file_name", "content_key").join(
        H.content_sets(entries).drop("set_pos"), ["collection", "catalog", "content_key"])
    assert {(r.file_name, r.set_name) for r in every.collect()} == {(f"f{i}.bin", f"s{j}") for i in range(2) for j in range(3)}
    # a further rule takes part like the built-in ones
    extra = rows.select("collection", "catalog", F.lit("odd.bin").alias("file_name"), F.lit("s3").alias("set_name"), F.lit(3).cast("bigint").alias("set_pos"),
                        F.lit(1).cast("bigint").alias("n_sets"), F.lit(0.9).alias("confidence"), F.lit("own rule").alias("reason"), F.lit("bb").alias("expected_hash"),
                        F.lit("bb").alias("actual_hash"), F.lit(True).alias("hash_match"), F.lit("rename").alias("action"), F.lit(2).alias("stage"), F.lit(50).alias("rule_ord")).limit(1)
    odd = spark.createDataFrame([("c", "odd.bin")], "collection string, file_name string")
    best = C.best_per_file(C.gather(files.union(odd), variants, entries, extra)).filter("file_name = 'odd.bin'").first()
    assert (best.set_name, best.reason, best.status) == ("s3", "own rule", "matched")


def test_any_number_of_candidates(spark):
    files = spark.createDataFrame([("c", "Tetris (Foo).zip")], FILES)
    rows = spark.createDataFrame([("c", "k", i, f"Super Tetris {i}x Challenge (USA)", f"h{i}") for i in range(40)], SETS)
    assert [r.name_rank for r in M.name_candidates(files, rows, top=20).orderBy("name_rank").collect()] == list(range(1, 21))
    bases = spark.createDataFrame([("c", "tetris")], "collection string, base_key string")
    assert M.base_candidates(bases, M.distinct_sets(rows)).count() == 40


def test_last_name_wins_among_case_variants(spark):
    got = names_for(spark, "game x (usa)", ["Game X (USA)", "GAME X (USA)"])
    assert (got[0].set_name, got[0].confidence) == ("GAME X (USA)", 0.95)


def test_only_five_and_none_lost_by_the_shorter_lists(spark):
    got = names_for(spark, "Foo Bar (U)", [f"Foo Bar Part {i:02d} (USA)" for i in range(40)] + ["Foo Bar (USA)", "foo bar (u)"])
    assert [r.set_name for r in got] == ["foo bar (u)", "Foo Bar (USA)"] + [f"Foo Bar Part {i:02d} (USA)" for i in range(3)]


def closest_for(spark, stems, sets):
    files = spark.createDataFrame([("c", "k", s + ".zip") for s in stems], "collection string, catalog string, file_name string")
    rows = spark.createDataFrame([("c", "k", i, s) for i, s in enumerate(sets)], "collection string, catalog string, set_pos bigint, set_name string")
    return {r.file_name[:-4]: r for r in CL.closest_sets(files, rows).collect()}


def test_closest_notes(spark):
    got = closest_for(spark, ["Foo (USA) [h1]", "zzz", "Foo (Japan)", "Super Marios"], ["Foo (Japan)", "Super Mario"])
    assert got["Foo (USA) [h1]"].note == "Similar: Foo (Japan) — ROM has: USA, h1; DAT has: Japan"
    assert got["Foo (Japan)"].note == "Similar: Foo (Japan) — Different naming convention"
    assert got["zzz"].note == "No similar DAT entry found" and got["zzz"].closest_set is None
    assert got["Super Marios"].note == "Similar: Super Mario"


@pytest.mark.parametrize("seed, low, high", [(1, 3, 12), (2, 8, 24), (3, 20, 34)])
def test_closest_masks_against_brute_force(spark, seed, low, high):
    """Sparse random letter sets: many have their best match farther than two letters away."""
    rng = random.Random(seed)
    letters = N.MASK_LETTERS
    def word():
        return "".join(sorted(rng.sample(letters, rng.randint(low, high))))
    asked, listed = list({word() for _ in range(150)}), list({word() for _ in range(150)})
    # near relatives as well
    for a in asked[:60]:
        drop, add = rng.randint(0, 4), rng.randint(0, 4)
        kept = rng.sample(a, max(1, len(a) - drop))
        listed.append("".join(sorted(set(kept) | set(rng.sample(letters, add)))))
    listed = list(dict.fromkeys(listed))

    def mask(w):
        return sum(1 << letters.index(x) for x in set(w))

    left = spark.createDataFrame([("c", "k", mask(w)) for w in asked], "collection string, catalog string, mask bigint")
    right = spark.createDataFrame([("c", "k", mask(w), i, w) for i, w in enumerate(listed)],
                                  "collection string, catalog string, mask bigint, set_pos bigint, set_name string")
    got = {r.mask: (r.set_name, round(r.score, 9)) for r in CL.nearest_masks(left, right).collect()}
    expected = {}
    for a in asked:
        best, best_score = None, 0.7
        for b in listed:
            score = len(set(a) & set(b)) / max(len(set(a)), len(set(b)))
            if score > best_score:
                best, best_score = b, score
        if best:
            expected[mask(a)] = (best, round(best_score, 9))
    assert got == expected and expected


def test_documented_collections(spark):
    cats = spark.createDataFrame([(a,) for a, _ in PAIRS], "catalog_name string")
    dirs = spark.createDataFrame([(b,) for _, b in PAIRS], "collection string")
    got = {(r.catalog_name, r.collection): r.score for r in CO.collection_scores(cats, dirs).collect()}
    special = {"Sega - Game Gear": 100.0, "NEC - PC Engine": 80.0}
    for a, b in PAIRS:
        assert got[a, b] == special.get(b, 90.0), (a, b)


def test_collection_scores(spark):
    expected = {
        ("Non-Redump - Sony - PlayStation 2", "Sony - PS2"): 90, ("Redump - Sony - PlayStation 2", "TOSEC - Sony - PS2"): 90,
        ("Redump - Sony - PlayStation 2", "Redump - Sony - PS2"): 23.333333, ("Nintendo - Game Boy Color", "Nintendo - Game Boy"): 80,
        ("Nintendo - Nintendo DSi", "Nintendo - DS"): 80, ("Nintendo - Nintendo 64 (BigEndian)", "Nintendo - N64"): 90,
        ("Nintendo - Super Nintendo Entertainment System", "Nintendo - NES"): 0, ("Sony - PlayStation 2", "Sony - PS1"): 0,
        ("TOSEC - Redump - MAME - No-Intro - Sony - PlayStation 2", "Sony - PS2"): 90,
        # both begin alike once a word is off, so the rest is compared as it is: 3 of 8 words
        ("Redump - TOSEC - MAME - No-Intro - Redump - Sony - PlayStation 2", "TOSEC - MAME - Redump - TOSEC - MAME - Sony - PS2"): 26.25,
        ("Redump - TOSEC - No-Intro - TOSEC - Sony - PlayStation 2", "MAME - Non-Redump - MAME - Non-Redump - Sony - PS2"): 90,
        ("Sega - Saturn", "Sony - Saturn"): 0, ("Sega - (x)", "Sega - Saturn"): 80, ("Saturn", "Sega - Saturn"): 100,
    }
    df = spark.createDataFrame([(a, b) for a, b in expected], "a string, b string")
    scored = {(r.a, r.b): round(r.score, 6) for r in CO.score_pairs(df, "a", "b").collect()}
    assert scored == expected
    # the blocking keys lose none of the positive ones
    cats = spark.createDataFrame([(a,) for a, _ in expected], "catalog_name string")
    dirs = spark.createDataFrame([(b,) for _, b in expected], "collection string")
    every = cats.distinct().crossJoin(dirs.distinct())
    full = {tuple(r) for r in CO.score_pairs(every, "catalog_name", "collection").filter("score > 0").collect()}
    assert {tuple(r) for r in CO.collection_scores(cats, dirs).select("catalog_name", "collection", "score").collect()} == full


def test_set_status(spark):
    entry = "collection string, catalog string, set_pos bigint, set_name string, entry_pos int, entry_name string, size bigint, hash string"
    entries = spark.createDataFrame([
        ("c", "k", 0, "both", 0, "a", 1, "h1"), ("c", "k", 0, "both", 1, "b", 1, "H2"), ("c", "k", 1, "none", 0, "a", 1, "x"),
        ("c", "k", 2, "half", 0, "a", 1, "y"), ("c", "k", 2, "half", 1, "b", 1, "h1"), ("c", "k", 3, "empty", None, None, None, None),
        ("c", "k", 4, "blank", 0, "a", 1, ""), ("c", "k", 5, "twice", 0, "a", 1, "h1"), ("c", "k", 5, "twice", 1, "a", 1, "zz"),
    ], entry)
    hashes = spark.createDataFrame(
        [("c", "b.zip", "m", "h1"), ("c", "a.zip", "n", "h1"), ("c", "c.bin", None, "h2"), ("c", "d.bin", None, ""), ("c", "e.bin", None, None)],
        "collection string, file_name string, member_name string, hash string")
    got = {r.set_name: (r.status, r.file_name, r.found, r.expected) for r in R.set_results(R.entry_results(entries, hashes)).collect()}
    assert got == {
        "both": ("ok", "a.zip", 2, 2), "none": ("missing", None, 0, 1), "half": ("bad_dump", None, 1, 2), "empty": ("ok", None, 0, 0),
        "blank": ("missing", None, 0, 1), "twice": ("ok", "a.zip", 2, 2)}
    assert {r.file_name for r in R.unmatched_files(hashes, entries).collect()} == {"d.bin", "e.bin"}


def test_greedy_pairs(spark):
    files = spark.createDataFrame([("c", "Foo (J).zip"), ("c", "Foo (U).zip")], FILES)
    sets = [("c", "k", i, f"Foo ({r})") for i, r in enumerate(["USA", "Japan", "Europe"])]
    schema = "collection string, catalog string, set_pos bigint, set_name string"
    pairs = P.pair_by_name(files, spark.createDataFrame(sets, schema))
    assert [r.file_name for r in pairs.orderBy("set_pos").collect()] == ["Foo (J).zip", "Foo (U).zip", "Foo (J).zip"]
    assert P.files_without_set(files, pairs).count() == 0
    one = P.pair_by_name(files, spark.createDataFrame(sets[:1], schema))
    assert [r.file_name for r in P.files_without_set(files, one).collect()] == ["Foo (U).zip"]


def test_position_in_hot_group(spark):
    """One key holds most rows; its positions are exact although it spreads over several slices."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 7, "").otherwise(F.col("id").cast("string")).alias("key"), ((F.col("id") * 7919) % 20_011).alias("o"))
    out = RK.position_in_group(df, ["key"], ["o"])
    hot = [r.k for r in out.filter("key = ''").orderBy("o").collect()]
    assert hot == list(range(1, 14_001)) and out.filter("key <> '' and k <> 1").count() == 0 and out.count() == 20_000


@pytest.mark.parametrize("sets, files, entry, held, matches, rating, text", [
    (10, 0, [".sfc"], [], 0, "red", "empty"), (0, 5, [], [".sfc"], 0, "red", "no games"), (10, 5, [".pkg"], [".iso"], 0, "red", "digital store"),
    (10, 5, [".sfc"], [".iso"], 5, "yellow", "disc images"), (10, 5, [".sfc"], [".nes"], 5, "red", "No extension match"),
    (10, 5, [".sfc"], [".sfc"], 3, "green", "3 filename matches (30% of DAT)"), (10, 5, [".sfc"], [".sfc"], 2, "yellow", "Only 2 filename matches (20% of DAT)"),
    (10, 5, [".sfc"], [".zip"], 0, "yellow", "No filename matches but"), (10, 5, [".sfc"], [".sfc"], 0, "red", "No filename matches. DAT expects .sfc, ROMs have .sfc"),
    (40, 5, [".sfc"], [".zip"], 1, "yellow", "(2% of DAT)"), (10, 5, [], [".nes"], 0, "red", "DAT expects (none)"),
])
def test_rating(spark, sets, files, entry, held, matches, rating, text):
    df = spark.createDataFrame([(sets, files, entry, held, matches)],
                               "set_count bigint, file_count bigint, entry_types array<string>, file_types array<string>, name_matches bigint")
    got = P.rate(df).first()
    assert got.rating == rating and text in got.reason


def test_failing_rules_leave_the_others(spark):
    """A rule that fails when planned, one that fails on a row, one that is fine: two errors, and the rows of the third."""
    from shelfmark.operators import candidates

    files = spark.createDataFrame([("c", "a.bin"), ("c", "b.bin")], "collection string, file_name string")

    def planned(files, variants, entries):
        raise ValueError("name boom")

    def on_a_row(files, variants, entries):
        return files.select("*", F.when(F.col("file_name") == "b.bin", F.raise_error(F.lit("disk on fire"))).otherwise("x").cast("string").alias("set_name"))

    def fine(files, variants, entries):
        return files.select("*", F.lit("s").alias("set_name"))

    found, failed = candidates.run_rules({"bad_name": planned, "bad": on_a_row, "fine": fine}, files, files, files)
    assert len(found) == 1 and found[0].count() == 2
    told = {r.rule: r.error for r in failed.collect()}
    assert set(told) == {"bad_name", "bad"} and "name boom" in told["bad_name"] and "disk on fire" in told["bad"]
    assert candidates.run_rules({}, files, files, files)[1].count() == 0
