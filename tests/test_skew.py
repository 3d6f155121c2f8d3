"""One key holds a third of the rows or more: results stay exact, and the join splits the key."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import hash_match as H
from shelfmark.operators import reconcile as R
from shelfmark.operators import resolve as RS

N_FILES, N_SETS = 6000, 3000


@pytest.fixture
def eager_skew(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_hashes(spark):
    """A third of the files hold the same content."""
    return spark.range(N_FILES).select(
        F.lit("c").alias("collection"), F.format_string("f%05d", "id").alias("file_name"), F.lit(None).cast("string").alias("member_name"),
        F.when(F.col("id") % 3 == 0, "empty").otherwise(F.concat(F.lit("h"), F.col("id").cast("string"))).alias("hash"))


def hot_entries(spark):
    """Half of the sets list it."""
    return spark.range(N_SETS).select(
        F.lit("c").alias("collection"), F.lit("k").alias("catalog"), F.col("id").alias("set_pos"), F.format_string("s%05d", "id").alias("set_name"),
        F.lit(0).alias("entry_pos"), F.lit("e").alias("entry_name"), F.lit(1).cast("bigint").alias("size"),
        F.when(F.col("id") % 2 == 0, "empty").otherwise(F.concat(F.lit("h"), F.col("id").cast("string"))).alias("hash"))


def test_hot_content(spark, eager_skew):
    hashes, entries = hot_hashes(spark), hot_entries(spark)
    sets = R.set_results(R.entry_results(entries, hashes))
    got = sets.groupBy("status").count().collect()
    # odd sets are held unless their file is one of the copies
    odd_held = sum(1 for i in range(1, N_SETS, 2) if i % 3)
    assert {r.status: r["count"] for r in got} == {"ok": N_SETS // 2 + odd_held, "missing": N_SETS // 2 - odd_held}
    variants = hashes.select(
        "collection", "file_name", F.lit("raw").alias("kind"), F.lit(None).cast("int").alias("prefix"), F.lit(None).cast("string").alias("label"), "hash")
    listed = H.direct_candidates(variants, entries)
    # one row per set, not one per file and set
    assert listed.count() == N_SETS // 2 + odd_held
    assert listed.filter("hash = 'empty'").select("n_files").distinct().collect()[0][0] == N_FILES // 3


def test_hot_set_keeps_one(spark, eager_skew):
    rows = spark.range(N_FILES).select(
        F.lit("c").alias("collection"), F.col("id").alias("row_pos"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("set_name"),
        F.lit("").alias("description"), F.format_string("f%05d", "id").alias("file_name"), F.lit("matched").alias("status"),
        F.lit("").alias("note"), F.when(F.col("id") == 4000, "ok").otherwise("modify").alias("plan"), F.lit("").alias("expected_file_name"))
    out = RS.mark_duplicates(rows)
    hot = out.filter("set_name = 'hot'")
    assert [r.file_name for r in hot.filter("status = 'matched'").collect()] == ["f04000"]
    assert hot.filter("status = 'duplicate' and note = 'Duplicate of f04000'").count() == 2 * N_FILES // 3 - 1
    assert out.filter("set_name <> 'hot' and status = 'matched'").count() == N_FILES // 3


def test_hot_join_key_is_split(spark, eager_skew):
    """The final plan reads the hot partition in several tasks."""
    entries = hot_entries(spark).withColumn("hash", F.when(F.col("set_pos") % 2 == 0, "empty").otherwise(F.col("hash")))
    wide = entries.withColumn("entry_name", F.concat(F.lit("e"), F.sha2(F.col("set_pos").cast("string"), 512)))
    out = wide.join(R.first_sources(hot_hashes(spark)), ["collection", "hash"], "left")
    out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
