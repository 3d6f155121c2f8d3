import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import names as N

AWKWARD = [
    "Gran Turismo 4 (USA) (v2.00)", "Sonic (USA) [!]", "[BIOS] Thing (Japan)", "(Unl) Game", "No tags", "A  (U) [b1] (J)",
    "Pokémon - Édition (F)", "x[y]z(w)", "Unclosed (USA", "", "Game - The Sequel: Part 2 (E) (M3)", "名前 (J)",
]

# what each rule makes of the names above, in their order
EXPECTED = {
    N.normalize_name: ["granturismo4", "sonic", "thing", "game", "notags", "a", "pokmondition", "xz", "unclosedusa", "", "gamethesequelpart2", ""],
    N.extract_base: ["Gran Turismo 4", "Sonic", "", "", "No tags", "A", "Pokémon - Édition", "x", "Unclosed", "", "Game - The Sequel: Part 2", "名前"],
    N.extract_base_name: ["Gran Turismo 4", "Sonic", "[BIOS] Thing", "(Unl) Game", "No tags", "A", "Pokémon - Édition", "x[y]z", "Unclosed", "",
                          "Game - The Sequel: Part 2", "名前"],
    N.variant_base: ["gran turismo 4", "sonic [!]", "[bios] thing", "game", "no tags", "a [b1]", "pokémon - édition", "x[y]z", "unclosed (usa", "",
                     "game - the sequel: part 2", "名前"],
    N.extract_region: ["USA", "USA", "Japan", "Unl", "", "U", "F", "w", "", "", "E", "J"],
}
TAGS = [{"USA", "v2.00"}, {"USA", "!"}, {"BIOS", "Japan"}, {"Unl"}, set(), {"U", "b1", "J"}, {"F"}, {"y", "w"}, set(), set(), {"E", "M3"}, {"J"}]


def test_rules_on_awkward_names(spark):
    df = spark.createDataFrame([(x,) for x in AWKWARD], ["x"])
    for fn, expected in EXPECTED.items():
        got = {r.x: r.v for r in df.select("x", fn(F.col("x")).alias("v")).collect()}
        assert got == dict(zip(AWKWARD, expected)), fn.__name__
    got = {r.x: set(r.v) for r in df.select("x", N.extract_tags(F.col("x")).alias("v")).collect()}
    assert got == dict(zip(AWKWARD, TAGS))


@pytest.mark.parametrize("name, expected", [
    ("Spawn (U)", "Spawn (USA)"), ("A (J) (E)", "A (Japan) (Europe)"), ("B (NL)", "B (Netherlands)"),
    ("C (u)", "C (u)"), ("D (As) (Q)", "D (Asia) (Q)"), ("E (USA)", "E (USA)"),
])
def test_expand_regions(one, name, expected):
    assert one(N.expand_regions, name) == expected


@pytest.mark.parametrize("name, ext, stem", [
    ("Game.SFC", ".sfc", "Game"), (".hidden", "", ".hidden"), ("a.b.zip", ".zip", "a.b"), ("noext", "", "noext"),
    ("dir/.x", "", ".x"), ("trailing.", "", "trailing."),
])
def test_extension_and_stem(one, name, ext, stem):
    assert one(N.extension, name) == ext
    assert one(N.stem, name) == stem


def test_clean_collection_name(one):
    assert one(N.clean_collection_name, "Nintendo - Game Boy (Parent-Clone) (20240101-123456)") == "Nintendo - Game Boy"
    assert one(N.clean_collection_name, "NEC - PC Engine (Japan)") == "NEC - PC Engine (Japan)"


def test_word_match(one):
    assert one(N.word_match, "tetris", "super tetris challenge")
    assert not one(N.word_match, "gon", "dragon")
    assert one(N.word_match, "foo - bar", "x foo - bar: y")
    assert not one(N.word_match, "foo bar", "foo-bar")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.text("ab -:,", min_size=1, max_size=5), st.text("ab -:,", max_size=9)), min_size=1, max_size=40))
def test_windows_equal_the_pattern(spark, pairs):
    df = spark.createDataFrame(pairs, "needle string, hay string")
    for r in df.select("*", N.word_match(F.col("needle"), F.col("hay")).alias("v")).collect():
        expected = re.search(r"(?:^|[\s\-,:])" + re.escape(r.needle) + r"(?:$|[\s\-,:])", r.hay)
        assert r.v == bool(expected), r


def test_word_windows_of_odd_texts(spark):
    """As by looking at each position; a text is cut once, not again for every word in it."""
    import random
    import re

    from pyspark.sql import functions as F

    draw = random.Random(11)
    texts = ["", " ", "--", "-a", "a-", *("".join(draw.choice(["a", "Bc", " ", "-", ",", ":", "é", "\U0001F600", "\t", " ", "x"]) for _ in range(draw.randrange(12))) for _ in range(300))]

    def slow(x):
        edge = lambda p: re.match(r"[\s\-,:]", x[p])
        return {x[i:j] for i in range(len(x)) if i == 0 or edge(i - 1) for j in range(i + 1, len(x) + 1) if j == len(x) or edge(j)}

    found = spark.createDataFrame([(x,) for x in texts], "x string").select("x", N.word_windows(F.col("x")).alias("w"))
    rows = found.collect()
    assert all(len(r.w) == len(set(r.w)) and set(r.w) == slow(r.x) for r in rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "filter(" not in plan
