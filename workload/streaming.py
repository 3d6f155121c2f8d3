"""Streams over events and documents, table refreshes, and catalogue files read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.operators import precheck as P
from shelfmark.sources import catalogs as CA
from shelfmark.sources import tables as TB
from shelfmark.streaming import incremental as I
from shelfmark.streaming import upsert as U
from workload import frames as fr
from workload.matching import PRE
from workload.registry import query


def _stream(spark, d, name):
    schema = fr.table(spark, d, name).schema
    # a table is one file or a folder of files of any name; the source takes a plain path for a folder, a pattern for either
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query("live_upserts", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def live_upserts(spark, d):
    path, checkpoint = session.scratch(spark, "upserts"), session.scratch(spark, "upserts-state")
    updates = _stream(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    U.start(updates, path, checkpoint, ["user_id"], ["event_id"]).awaitTermination()
    return U.current(spark, path, ["user_id"], ["event_id"])


# updates of all events, under keys of which the table has every other one
@query("replaced_rows", """WITH upd AS (SELECT user_id * 2 AS user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id)
SELECT user_id, event_id, event_type FROM events e WHERE user_id NOT IN (SELECT user_id FROM upd)
UNION ALL SELECT user_id, event_id, event_type FROM upd""")
def replaced_rows(spark, d):
    events = fr.table(spark, d, "events").select("user_id", "event_id", "event_type")
    updates = U.last_per_key(events.withColumn("user_id", F.col("user_id") * 2), ["user_id"], ["event_id"])
    return U.replace_rows(events, updates, ["user_id"])


@query("incremental_reconcile", fr.DOCS + """
SELECT e.collection, e.catalog, h.hash, min(h.file_name) AS file_name, CAST(NULL AS VARCHAR) AS member_name, count(*) AS n_copies
FROM doc_hash h JOIN (SELECT DISTINCT collection, catalog, hash FROM doc_entry) e ON e.collection = h.collection AND e.hash = h.hash GROUP BY e.collection, e.catalog, h.hash""")
def incremental_reconcile(spark, d):
    path, checkpoint = session.scratch(spark, "arrivals"), session.scratch(spark, "arrivals-state")
    arrivals = _stream(spark, d, "documents").selectExpr(
        f"{fr.DOC_COLLECTION} AS collection", f"{fr.DOC_NAME} AS file_name", "CAST(NULL AS STRING) AS member_name",
        f"md5(encode({fr.DOC_HELD}, 'UTF-8')) AS hash")
    I.start(arrivals, fr.doc_entries(spark, d), path, checkpoint).awaitTermination()
    return I.found(spark, path)


# all documents arrive, every fourth comes again with other content and every third as it was; half of the catalogue's entries are added last
@query("incremental_changes", fr.DOCS + """
SELECT e.collection, e.catalog, h.hash, min(h.file_name) AS file_name, CAST(NULL AS VARCHAR) AS member_name, count(*) AS n_copies
FROM (SELECT * FROM doc_hash WHERE CAST(regexp_extract(file_name, '[0-9]+') AS INT) % 4 <> 0) h
JOIN (SELECT DISTINCT collection, catalog, hash FROM doc_entry) e ON e.collection = h.collection AND e.hash = h.hash GROUP BY e.collection, e.catalog, h.hash""")
def incremental_changes(spark, d):
    path, checkpoint, inbox = (session.scratch(spark, x) for x in ("arrivals", "arrivals-state", "inbox"))
    number = F.regexp_extract("file_name", "[0-9]+", 0).cast("int")
    every, entries = fr.doc_hashes(spark, d).select(*I.FILE, "hash"), fr.doc_entries(spark, d)

    def deliver(rows: DataFrame, wanted: DataFrame) -> None:
        rows.write.mode("append").parquet(inbox)
        I.start(spark.readStream.schema(every.schema).parquet(inbox), wanted, path, checkpoint).awaitTermination()

    deliver(every, entries.where(F.xxhash64("set_name") % 2 == 0))
    I.compact(spark, path)
    deliver(every.where(number % 4 == 0).withColumn("hash", F.md5(F.concat(F.lit("changed "), "hash"))), entries.where(F.xxhash64("set_name") % 2 == 0))
    deliver(every.where((number % 3 == 0) & (number % 4 != 0)), entries.where(F.xxhash64("set_name") % 2 == 0))
    I.compact(spark, path)
    I.refresh_wanted(entries, path)
    return I.found(spark, path)


@query("scoped_refresh", fr.RESULTS + """
SELECT r.* REPLACE (CASE WHEN collection = 'PROMO' THEN 'refreshed' ELSE note END AS note) FROM result r""")
def scoped_refresh(spark, d):
    path = session.scratch(spark, "results")
    rows = fr.results(spark, d)
    TB.refresh(rows, path, whole=True)
    TB.refresh(rows.filter("collection = 'PROMO'").withColumn("note", F.lit("refreshed")), path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


#: sets a written catalogue may list
GAMES = 20_000


@query("catalog_scan", "WITH " + fr.SQL_PART_SET + """
SELECT set_name, 'Set ' || set_name AS description, CAST(entry_pos AS INT) AS entry_pos, entry_name, size, '00000012' AS crc, hash AS md5, CAST(NULL AS VARCHAR) AS sha1 FROM part_set""")
def catalog_scan(spark, d):
    """Catalogues written as XML by Spark and scanned back: a task reads a catalogue as a whole, so more data make more of them."""
    path = session.scratch(spark, "catalogs")
    rom = F.struct(F.col("entry_name").alias("_name"), F.col("size").alias("_size"), F.lit("00000012").alias("_crc"), F.col("hash").alias("_md5"))
    fr.part_sets(spark, d).select(
        F.col("set_name").alias("_name"), F.concat(F.lit("  Set "), "set_name", F.lit(" ")).alias("description"), F.array(rom).alias("rom")
    ).write.format("xml").option("maxRecordsPerFile", GAMES).option("rootTag", "datafile").option("rowTag", "game").save(path)
    return CA.read_entries(spark, path, "part-*").drop("catalog_path", "set_pos")


@query("precheck_tables", PRE + """
SELECT collection, status, count(*) AS n_rows FROM (SELECT collection, CASE WHEN file_name IS NULL THEN 'missing' ELSE 'unverified' END AS status FROM pair
  UNION ALL SELECT collection, 'unmatched' FROM loose) GROUP BY ALL
UNION ALL SELECT collection, 'profiles', count(DISTINCT catalog) FROM pair GROUP BY ALL""")
def precheck_tables(spark, d):
    """Both outputs of a precheck written and read back."""
    files, entries = session.cut(fr.part_files(spark, d)), session.cut(fr.part_sets(spark, d))
    # read by three joins of the rows: a table, not its aggregate again in each of their plans
    sets = session.cut(P.sets_of(entries))
    pairs = session.cut(P.pair_by_name(files, sets))
    profiles, rows = P.rate(P.profile(files, entries, pairs)), P.result_rows(files, sets, pairs)
    there, here = session.scratch(spark, "profiles"), session.scratch(spark, "rows")
    TB.write_precheck(profiles, rows, there, here)
    counts = spark.read.schema(rows.schema).parquet(here).groupBy("collection", "status").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = spark.read.schema(profiles.schema).parquet(there).groupBy("collection").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.unionByName(kept.withColumn("status", F.lit("profiles")))
