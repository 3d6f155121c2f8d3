import pytest
from pyspark.sql import functions as F

from shelfmark.operators import regions as RG
from shelfmark.operators import resolve as RS
from shelfmark.operators import views as V
from shelfmark.plans import routing as RT
from shelfmark.sources import tables as TB
from shelfmark.streaming import incremental as I
from shelfmark.streaming import upsert as U

ROW = ("collection string, row_pos bigint, set_name string, description string, file_name string, status string, note string, plan string, "
       "expected_file_name string")


def rows(spark, *items):
    return spark.createDataFrame([("c", i, s, s, f, st, "", p, f"{s}.zip") for i, (s, f, st, p) in enumerate(items)], ROW)


def test_keeper(spark):
    df = rows(spark, ("X", "b.zip", "matched", "ok"), ("X", "a.zip", "matched", "modify"), ("X", "c.zip", "matched", "ok"), ("Y", None, "missing", None))
    got = {r.file_name: (r.status, r.note, r.plan) for r in RS.mark_duplicates(df).collect()}
    assert got == {"b.zip": ("matched", "", "ok"), "a.zip": ("duplicate", "Duplicate of b.zip", ""),
                   "c.zip": ("duplicate", "Duplicate of b.zip", ""), None: ("missing", "", None)}


def test_variants(spark):
    df = rows(spark, ("ActRaiser (USA)", "a.zip", "matched", "ok"), ("ActRaiser (France)", "b.zip", "unverified", ""),
              ("ActRaiser 2 (France)", "c.zip", "unverified", ""), ("Else (USA)", "a.zip", "unverified", ""), ("ActRaiser (Japan)", None, "missing", ""))
    assert {r.set_name for r in RS.drop_stale_variants(df).collect()} == {"ActRaiser (USA)", "ActRaiser 2 (France)", "ActRaiser (Japan)"}


def test_apply_matches(spark):
    df = rows(spark, ("A", "f.zip", "unverified", ""), ("B", "f.zip", "unverified", ""), ("C", None, "missing", ""), ("D", "g.zip", "unmatched", ""))
    m = spark.createDataFrame([("c", "f.zip", "Z", "why", "modify")], "collection string, file_name string, matched_set string, reason string, plan_label string")
    got = sorted((r.row_pos, r.set_name, r.status, r.plan) for r in RS.apply_matches(df, m).collect())
    assert got == [(0, "Z", "matched", "modify"), (2, "C", "missing", ""), (3, "D", "unmatched", "")]


PREFER = ["USA", "World", "Europe", "Japan"]


@pytest.mark.parametrize("names, prefer, out", [
    (["Perfect Dark (USA)", "Perfect Dark (Europe)", "Perfect Dark (Japan)"], PREFER, ["Perfect Dark (Europe)", "Perfect Dark (Japan)"]),
    (["Tetris (World)", "Tetris (Japan)"], PREFER, ["Tetris (Japan)"]),
    (["Game (USA)"], PREFER, []),
    (["Game (Korea)"], ["USA"], ["Game (Korea)"]),
    (["Game (USA)", "Game (Japan)"], [], []),
    (["Perfect Dark (USA)", "Perfect Dark (USA) (Rev 1)"], PREFER, []),
    (["Mario (USA)", "Mario (Japan)", "Zelda (USA)", "Zelda (Europe)"], PREFER, ["Mario (Japan)", "Zelda (Europe)"]),
    (["Naruto (Japan)", "Naruto (Korea)"], ["USA"], ["Naruto (Japan)", "Naruto (Korea)"]),
])
def test_regions(spark, names, prefer, out):
    df = spark.createDataFrame([("c", n + ".zip", n) for n in names], "collection string, file_name string, set_name string")
    assert sorted(r.set_name for r in RG.region_exclusions(df, prefer).filter("excluded").collect()) == sorted(out)


def test_queue(spark):
    df = spark.createDataFrame([
        ("c", "old.zip", "Foo", 0, False), ("c", "new.zip", "Foo", 1, True), ("c", "alone.zip", "", 2, True)],
        "collection string, file_name string, set_name string, queue_pos bigint, is_new boolean")
    assert {r.file_name for r in RG.one_file_per_set(df, PREFER).collect()} == {"old.zip", "alone.zip"}
    assert [(r.kept_file, r.dropped_file) for r in RG.queue_conflicts(df, PREFER).collect()] == [("old.zip", "new.zip")]


def test_routing(spark):
    df = rows(spark, ("A (USA)", "a", "matched", "ok"), ("A (Japan)", "b", "matched", "ok"), ("C (USA)", "c", "matched", "exclude"), ("D", "d", "unmatched", ""),
              ("E", "e", "duplicate", ""), ("F", "f", "ok", "exclude"), ("G (USA)", "g", "matched", "ok"), ("H", "h", "unverified", ""), ("I", "i", "bad_dump", ""))
    asked = spark.createDataFrame([("c", x) for x in "abcdefghiz"], "collection string, file_name string")
    disk = asked.filter("file_name <> 'g'")
    got = {r.file_name: (r.outcome, r.reason) for r in RT.route(asked, df, disk, ["USA"]).collect()}
    assert got == {
        "a": ("export", ""), "b": ("excluded", "Region-excluded (prefer USA)"), "c": ("excluded", "Excluded"),
        "d": ("failed", "Skipped (no CRC match in DAT (fan translation, hack, or bad dump))"), "e": ("duplicate", "Skipped (duplicate)"),
        "f": ("excluded", "Excluded"), "g": ("failed", "File not found on disk"), "h": ("failed", "Skipped (run Analyze first)"),
        "i": ("failed", "Skipped (status: bad_dump)"), "z": ("failed", "Not in database — run Scan first")}


def test_grid(spark):
    df = rows(spark, *[(f"Game {i}", f"g{i}.zip", "ok", "") for i in range(5)], *[(f"Gone {i}", None, "missing", "") for i in range(3)])
    assert V.default_view(df).count() == 5
    assert V.text_filter(df, {"set_name": " GAME 3 "}).count() == 1 and V.text_filter(df, {"set_name": "  "}).count() == 8
    assert V.value_filter(df, {"file_name": [""]}).count() == 3
    facets = V.facets(df, ["status", "file_name"], {"status": ["missing"]})
    assert {tuple(r) for r in facets.collect()} == {("status", "ok"), ("status", "missing"), ("file_name", "")}
    counts = V.view_counts(df).first()
    assert (counts.owned_count, counts.missing_count, counts.total_count) == (5, 3, 8)
    assert V.view_rows(df).count() == 5 and V.view_rows(df, "missing").count() == 3 and V.view_rows(df, "all").count() == 8


def test_natural_sort(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["b", "10 x", "9", "A", "-1", ""])], "pos int, label string")
    assert [r.label for r in V.natural_sort(df, "label", "pos").collect()] == ["-1", "9", "10 x", "", "A", "b"]
    assert [r.label for r in V.natural_sort(df, "label", "pos", ascending=False).collect()] == ["b", "A", "", "10 x", "9", "-1"]


def test_upserts_over_batches(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "key string, seq bigint, value string"
    def add(*items):
        spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(source)
    def run():
        U.start(spark.readStream.schema(schema).parquet(source), path, state, ["key"], ["seq"]).awaitTermination()
    add(("a", 1, "old"), ("b", 2, "b"), ("a", 3, "mid"))
    run()
    add(("a", 4, "new"), ("c", 5, "c"))
    run()
    run()  # nothing new
    got = {r.key: r.value for r in U.current(spark, path, ["key"], ["seq"]).collect()}
    assert got == {"a": "new", "b": "b", "c": "c"}
    U.compact(spark, path, str(tmp_path / "base"), ["key"], ["seq"])
    assert {r.key: r.value for r in U.current(spark, str(tmp_path / "base"), ["key"], ["seq"]).collect()} == got


def test_incremental_reconcile_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "collection string, file_name string, member_name string, hash string"
    entries = spark.createDataFrame([("c", "k", "h1"), ("c", "k", "h2"), ("c", "k", "h3")], "collection string, catalog string, hash string")
    for batch in ([("c", "z.zip", None, "H1"), ("c", "y.zip", None, "nope")], [("c", "a.zip", None, "h1"), ("c", "b.zip", None, "h2")],
                  [("c", "a.zip", None, "h1"), ("c", "b.zip", None, "h3")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        I.start(spark.readStream.schema(schema).parquet(source), entries, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.hash: (r.file_name, r.n_copies) for r in I.found(spark, str(tmp_path / "out")).collect()}
    # delivered again: counted once; changed: no longer what it was
    assert got == {"h1": ("a.zip", 2), "h3": ("b.zip", 1)}


def test_refresh_touches_only_its_collections(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "collection string, v int")
    TB.refresh(df, path, whole=True)
    TB.refresh(df.filter("collection = 'a'").withColumn("v", F.lit(9)), path)
    assert {(r.collection, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}
    TB.refresh_collection(df.filter("v > 5"), path, "b")
    assert {(r.collection, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9)}
    odd = df.limit(1).withColumn("collection", F.lit("Sega: 32X / [x] = 100%"))
    TB.refresh(odd, path)
    TB.refresh_collection(odd.withColumn("v", F.lit(7)), path, "Sega: 32X / [x] = 100%")
    assert {(r.collection, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("Sega: 32X / [x] = 100%", 7)}
    TB.refresh(df.filter("collection = 'b'"), path, whole=True)
    assert {(r.collection, r.v) for r in spark.read.parquet(path).collect()} == {("b", 2)}
