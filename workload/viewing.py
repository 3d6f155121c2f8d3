"""Result views over part, file details over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import views as V
from workload import frames as fr
from workload.frames import COLLECTIONS, MEMBERS, RESULTS
from workload.registry import query

_STATUS = {"status": ["matched", "ok", ""], "plan": ["ok", ""]}
_WHERE = {"status": "coalesce(status, '') IN ('matched', 'ok', '')", "plan": "coalesce(plan, '') IN ('ok', '')"}
_ALL = " AND ".join(_WHERE.values())


def _view(name, sql, fn):
    query(name, RESULTS + sql)(lambda spark, d: fn(fr.results(spark, d)))


_view("value_filter", f" SELECT * FROM result WHERE {_ALL}", lambda r: V.value_filter(r, _STATUS))
_view("text_filter", " SELECT * FROM result WHERE contains(lower(coalesce(set_name, '')), 'widget') AND contains(lower(coalesce(file_name, '')), 'brand')",
      lambda r: V.text_filter(r, {"set_name": " Widget ", "file_name": "BRAND", "note": "  "}))
_view("facets", f""" SELECT DISTINCT 'status' AS facet, coalesce(status, '') AS value FROM result WHERE {_WHERE['plan']}
UNION ALL SELECT DISTINCT 'plan', coalesce(plan, '') FROM result WHERE {_WHERE['status']}
UNION ALL SELECT DISTINCT 'set_name', set_name FROM result WHERE {_ALL}""",
      lambda r: V.facets(r, ["status", "plan", "set_name"], _STATUS))
_view("default_view", " SELECT * FROM result WHERE status IN ('ok', 'unverified', 'unmatched', 'matched')", V.default_view)
_view("focus_view", """ SELECT r.* FROM result r WHERE status IN ('ok', 'unverified', 'unmatched', 'matched', 'duplicate') AND EXISTS (
  SELECT 1 FROM result a WHERE a.status = 'matched' AND a.collection = r.collection AND a.description = r.description)""",
      lambda r: V.focus_view(r, r.filter("status = 'matched'")))
_view("analysed_only", " SELECT * FROM result WHERE status <> '' AND status <> 'unverified'", V.analysed_only)
_view("skipped_counts", " SELECT collection, count(*) FILTER (status <> 'unverified') AS n_queued, count(*) FILTER (status = 'unverified') AS n_skipped FROM result GROUP BY ALL",
      V.skipped_count)
_view("view_rows", """ SELECT *, CASE status WHEN 'missing' THEN 'missing' WHEN 'unmatched' THEN 'unmatched' ELSE 'owned' END AS view,
  CASE status WHEN 'missing' THEN 3 WHEN 'unmatched' THEN 2 ELSE 1 END AS view_ord FROM result""", lambda r: V.view_rows(r, "all"))
_view("owned_view", """ SELECT *, CASE status WHEN 'unmatched' THEN 'unmatched' ELSE 'owned' END AS view, CASE status WHEN 'unmatched' THEN 2 ELSE 1 END AS view_ord
  FROM result WHERE status <> 'missing'""", V.view_rows)
_view("view_counts", """ SELECT collection, count(*) FILTER (status NOT IN ('missing', 'unmatched')) AS owned_count, count(*) FILTER (status = 'unmatched') AS unmatched_count,
  count(*) FILTER (status = 'missing') AS missing_count, count(*) AS total_count FROM result GROUP BY ALL""", V.view_counts)
_view("status_summary", """ SELECT collection, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'unverified') AS unverified,
  count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'bad_dump') AS bad_dump,
  count(*) FILTER (status NOT IN ('ok', 'unverified', 'missing', 'bad_dump')) AS other FROM result GROUP BY ALL""", V.status_summary)
_view("distinct_files", " SELECT file_name, min(row_pos) AS first_pos FROM result GROUP BY file_name",
      lambda r: V.first_seen(r, ["file_name"], "row_pos"))

# numbers in front of some names
_MIXED = "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) || '.5 ' || p_name WHEN p_size % 3 = 1 THEN '-' || CAST(p_size AS STRING) ELSE p_brand END"


@query("natural_sort", rf"""
SELECT p_partkey, label, is_text, round(number, 6) AS number, text_key FROM (SELECT *, number IS NULL AS is_text FROM (
  SELECT p_partkey, {_MIXED} AS label, lower({_MIXED}) AS text_key,
    CAST(nullif(regexp_extract({_MIXED}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE) AS number FROM part))""")
def natural_sort(spark, d):
    rows = fr.table(spark, d, "part").selectExpr("p_partkey", f"{_MIXED} AS label")
    return V.natural_sort(rows, "label", "p_partkey").withColumn("number", F.round("number", 6))


@query("overview", COLLECTIONS + ", " + RESULTS.removeprefix("WITH ") + """, named AS (SELECT DISTINCT collection FROM directory_row)
SELECT 'collections' AS metric, count(*) AS value FROM named UNION ALL SELECT 'catalogs', count(*) FROM catalog_row UNION ALL SELECT 'directories', count(*) FROM directory_row
UNION ALL SELECT 'results', count(*) FROM result UNION ALL SELECT 'stale_collections', count(*) FROM (SELECT DISTINCT collection FROM result WHERE collection NOT IN (SELECT collection FROM named))
UNION ALL SELECT 'last_run', epoch_us(max(ts)) FROM events WHERE event_type = 'purchase'""")
def overview(spark, d):
    dirs = fr.directories(spark, d)
    runs = fr.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("ts").alias("finished"))
    return V.overview(dirs.select("collection").distinct(), fr.catalogs(spark, d), dirs, fr.results(spark, d), runs)


# one collection lost its directory
_MOVED = "CASE p_type WHEN 'PROMO' THEN 'MOVED' ELSE p_type END"


@query("stale_collections", RESULTS + f" SELECT DISTINCT collection FROM result WHERE collection NOT IN (SELECT {_MOVED} FROM part)")
def stale_collections(spark, d):
    return V.stale_collections(fr.results(spark, d), fr.table(spark, d, "part").selectExpr(f"{_MOVED} AS collection"))


# every nation is a collection, under a number that some customers' collections don't have
@query("named_prechecks", """SELECT c_custkey, c_nationkey AS collection_id, coalesce(s.collection, 'Unknown') AS collection
FROM customer LEFT JOIN (SELECT n_nationkey + 7 AS collection_id, n_name AS collection FROM nation) s ON s.collection_id = c_nationkey""")
def named_prechecks(spark, d):
    rows = fr.table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey AS collection_id")
    known = fr.table(spark, d, "nation").selectExpr("n_nationkey + 7 AS collection_id", "n_name AS collection")
    return V.with_collection_name(rows, known)


@query("located_files", """SELECT l_returnflag AS collection, 'file-' || CAST(l_partkey AS VARCHAR) AS file_name, arg_min('dir-' || CAST(l_suppkey AS VARCHAR), l_suppkey) AS directory
FROM lineitem GROUP BY ALL""")
def located_files(spark, d):
    held = fr.table(spark, d, "lineitem").selectExpr(
        "l_returnflag AS collection", "'file-' || CAST(l_partkey AS STRING) AS file_name", "'dir-' || CAST(l_suppkey AS STRING) AS directory",
        "l_suppkey AS directory_pos")
    return V.locate_files(held, held)


_DETAILS = MEMBERS + """,
kind AS (SELECT *, substr(ext, 2) AS member_type FROM typed),
row_of AS (SELECT collection, file_name, CAST(member_pos AS BIGINT) AS row_pos, 'Set ' || crc AS set_name FROM member),
step_of AS (SELECT collection, file_name, CAST(member_pos AS BIGINT) AS step_pos, member_name FROM kind WHERE member_type = 'txt')
SELECT collection, file_name, 'file' AS section, CAST(0 AS BIGINT) AS item_pos, 'zip' AS item, CAST(CAST(sum(size) AS BIGINT) AS VARCHAR) AS detail FROM member GROUP BY collection, file_name
UNION ALL SELECT collection, file_name, 'member', member_pos, member_name, member_type || ' ' || CAST(size AS VARCHAR) || ' ' || crc FROM kind
UNION ALL SELECT collection, file_name, 'result', row_pos, set_name, 'matched  ok' FROM row_of
UNION ALL SELECT collection, file_name, 'step', step_pos, 'remove_embedded', member_name FROM step_of"""


@query("file_details", _DETAILS)
def file_details(spark, d):
    members = fr.members(spark, d)
    files = members.groupBy("collection", "file_name").agg(F.sum("size").alias("size"))
    rows = members.select(
        "collection", "file_name", F.col("member_pos").alias("row_pos"), F.concat(F.lit("Set "), "crc").alias("set_name"),
        F.lit("matched").alias("status"), F.lit("").alias("note"), F.lit("ok").alias("plan"))
    steps = members.filter(F.col("member_name").endswith(".txt")).select(
        "collection", "file_name", F.col("member_pos").alias("step_pos"), F.lit("remove_embedded").alias("name"),
        F.col("member_name").alias("description"))
    return V.file_details(files, members, rows, steps)
