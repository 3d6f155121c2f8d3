"""Nothing is broadcast by estimate: an estimate doesn't see rows multiply, and the driver holds what is broadcast."""

from pyspark.sql import functions as F

from shelfmark.operators import closest as CL
from shelfmark.operators import name_match as M
from shelfmark.operators.reconcile import SCOPE

PLACE = ["'c' AS collection", "'k' AS catalog"]


def planned(df) -> str:
    """The plan before anything ran."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_masks_are_not_broadcast(spark):
    masks = spark.range(1, 20).selectExpr(*PLACE, "id * 1234567 AS mask")
    listed = masks.select("*", F.col("mask").alias("set_pos"), F.lit("s").alias("set_name"))
    here, there = (CL._remainders(df, [*SCOPE, "mask"], 2) for df in (masks, listed))
    assert "BroadcastHashJoin" not in planned(here.join(there.groupBy(*SCOPE, "core").agg(F.min("lost")), [*SCOPE, "core"]))
    assert "BroadcastHashJoin" not in planned(CL.nearest_masks(masks, listed))


def test_words_are_not_broadcast(spark):
    sets = spark.range(20).selectExpr(*PLACE, "id AS set_pos", "'Some Long Name ' || id || ' (USA)' AS set_name", "'h' AS first_hash")
    files = sets.select("collection", F.concat("set_name", F.lit(".zip")).alias("file_name"))
    for found in (M.name_candidates(files, sets), M.full_name_candidates(M.stems(files), M.distinct_sets(sets))):
        assert "BroadcastHashJoin" not in planned(found)


def test_some_megabytes_are_not_broadcast(spark):
    """Joins with lists of less than 10 MB each met on the driver, several at a time."""
    named = spark.range(60_000).selectExpr("id", "repeat(md5(CAST(id AS STRING)), 2) AS name")
    joined = named.join(named.select("name", F.col("id").alias("other")), "name").agg(F.sum("other").alias("n"))
    assert joined.first()["n"] == 60_000 * 59_999 // 2
    joined.collect()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_stems_and_sets_are_tables_of_their_own(spark):
    """Each join held the whole plan of both sides again, and the driver every version of it."""
    sets = spark.range(10).selectExpr(*PLACE, "id AS set_pos", "concat('name ', id) AS set_name", "'h' AS first_hash")
    files = sets.select("collection", F.concat("set_name", F.lit(".zip")).alias("file_name"))
    found = M.name_candidates(files, sets)
    assert "Range (" not in planned(found)
    assert found.filter("name_rank = 1 AND stem = set_name").count() == 10


def test_sets_of_a_precheck_are_a_table(spark, monkeypatch):
    """Each join of the rows held the aggregate that makes the sets again."""
    from workload import streaming as ST

    given = []
    plain = ST.P.result_rows
    monkeypatch.setattr(ST.P, "result_rows", lambda files, sets, pairs: given.append(sets) or plain(files, sets, pairs))
    rows = ST.precheck_tables(spark, "/root/testdata/sf0.001").collect()
    assert "Aggregate" not in planned(given[0]) and sum(r.n_rows for r in rows if r.status in ("unverified", "missing")) == 200
