"""Streams of tables that are folders, and a check that nothing has arrived for."""

from shelfmark.streaming import incremental as I
from workload import frames as fr
from workload import streaming as ST

ARRIVAL = "collection string, file_name string, member_name string, hash string"
ENTRY = "collection string, catalog string, set_pos bigint, set_name string, entry_pos int, entry_name string, size bigint, hash string"


def test_table_of_several_files_arrives_whole(spark, tmp_path):
    for table, files in (("events", 3), ("labels", 1)):
        spark.range(60).repartition(files).write.parquet(f"{tmp_path}/{table}.parquet")
        out, checkpoint = f"{tmp_path}/{table}-out", f"{tmp_path}/{table}-state"
        ST._stream(spark, str(tmp_path), table).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.schema("id long").parquet(out).count() == 60


def test_table_of_one_file_arrives(spark):
    d = "/root/testdata/sf0.001"
    seen = []
    ST._stream(spark, d, "labels").writeStream.foreachBatch(lambda batch, _: seen.append(batch.count())).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == fr.table(spark, d, "labels").count() > 0


def test_nothing_has_arrived(spark, tmp_path):
    inbox, path = f"{tmp_path}/inbox", f"{tmp_path}/check"
    spark.createDataFrame([], ARRIVAL).write.parquet(inbox)
    entries = spark.createDataFrame([("c", "k", 1, "s", 0, "e", 1, "h")], ENTRY)
    I.start(spark.readStream.schema(ARRIVAL).parquet(inbox), entries, path, f"{tmp_path}/state").awaitTermination()
    assert I.compact(spark, path) == -1
    assert I.found(spark, path).collect() == []
