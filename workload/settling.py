"""Settling result rows, regions, queues and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import regions as RG
from shelfmark.operators import resolve as RS
from shelfmark.plans import routing as RT
from workload import frames as fr
from workload.frames import RESULTS
from workload.registry import query

# settled files are matched to the set of their part, the others under a name no result has
_SETTLED = f"({fr.RESULT['status']}) IN ('matched', 'ok', 'duplicate')"
_MATCH = {
    "collection": "p_type", "file_name": f"({fr.RESULT['file_name']}) || CASE WHEN {_SETTLED} THEN '' ELSE '.other' END", "matched_set": fr.SET_NAME,
    "reason": "'Direct CRC match'", "plan_label": "CASE WHEN p_size % 3 = 0 THEN 'ok' ELSE 'modify' END",
}
_COLS = ["collection", "row_pos", "set_name", "description", "file_name", "expected_file_name", "status", "note", "plan"]
_LIST = ", ".join(_COLS)
# a file was found under several sets before it was analysed: one row per part and per longer name
_MANY = f"""many AS (SELECT {_LIST} FROM result UNION ALL
  SELECT collection, row_pos + 1000000000, 'Other ' || set_name, description, file_name, expected_file_name, 'unverified', note, plan FROM result)"""
_MATCHES = f"match AS (SELECT {', '.join(fr._columns(_MATCH))} FROM part)"


def _many(spark, d):
    rows = fr.results(spark, d)
    again = rows.withColumns({
        "row_pos": F.col("row_pos") + 1000000000, "set_name": F.concat(F.lit("Other "), "set_name"), "status": F.lit("unverified")})
    return rows.unionByName(again)


def _matches(spark, d):
    return fr.table(spark, d, "part").selectExpr(*fr._columns(_MATCH))


@query("applied_matches", RESULTS + f""", {_MANY}, {_MATCHES}
SELECT m.collection, m.row_pos, x.matched_set AS set_name, x.matched_set AS description, m.file_name, x.matched_set || '.zip' AS expected_file_name,
  'matched' AS status, x.reason AS note, x.plan_label AS plan
FROM (SELECT *, row_number() OVER (PARTITION BY collection, file_name ORDER BY row_pos) AS rn FROM many WHERE file_name IS NOT NULL) m
JOIN match x ON x.collection = m.collection AND x.file_name = m.file_name WHERE rn = 1
UNION ALL
SELECT {_LIST} FROM many m WHERE NOT EXISTS (SELECT 1 FROM match x WHERE x.collection = m.collection AND x.file_name = m.file_name)""")
def applied_matches(spark, d):
    return RS.apply_matches(_many(spark, d), _matches(spark, d))


SQL_SETTLED = """keeper AS (SELECT collection, set_name, file_name AS keeper FROM (
  SELECT *, row_number() OVER (PARTITION BY collection, set_name ORDER BY CASE WHEN plan = 'ok' THEN 0 ELSE 1 END, file_name) AS rn FROM result WHERE status = 'matched') WHERE rn = 1),
settled AS (SELECT r.* REPLACE (
  CASE WHEN r.status = 'matched' AND k.keeper <> r.file_name THEN 'duplicate' ELSE r.status END AS status,
  CASE WHEN r.status = 'matched' AND k.keeper <> r.file_name THEN 'Duplicate of ' || k.keeper ELSE r.note END AS note,
  CASE WHEN r.status = 'matched' AND k.keeper <> r.file_name THEN '' ELSE r.plan END AS plan)
  FROM result r LEFT JOIN keeper k ON k.collection = r.collection AND k.set_name = r.set_name)"""

query("duplicate_keepers", RESULTS + f", {SQL_SETTLED} SELECT {_LIST} FROM settled")(
    lambda spark, d: RS.mark_duplicates(fr.results(spark, d)))


@query("stale_variants_dropped", RESULTS + rf""", based AS (SELECT *, lower(trim(regexp_replace(set_name, '\s*\([^)]*\)\s*', ' ', 'g'))) AS base FROM result)
SELECT {_LIST} FROM based b WHERE status <> 'unverified' OR (
  NOT EXISTS (SELECT 1 FROM based m WHERE m.status = 'matched' AND m.collection = b.collection AND m.base = b.base)
  AND NOT EXISTS (SELECT 1 FROM based m WHERE m.status = 'matched' AND m.collection = b.collection AND m.file_name = b.file_name))""")
def stale_variants_dropped(spark, d):
    return RS.drop_stale_variants(fr.results(spark, d))


@query("plan_updates", RESULTS + f""", chosen AS (SELECT collection, file_name FROM result WHERE status = 'duplicate')
SELECT r.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM chosen c WHERE c.collection = r.collection AND c.file_name = r.file_name) THEN 'exclude' ELSE plan END AS plan) FROM result r""")
def plan_updates(spark, d):
    rows = fr.results(spark, d)
    return RS.set_plan(rows, rows.filter("status = 'duplicate'"), "exclude")


@query("error_rows", RESULTS + """, failed AS (SELECT collection, file_name, 'ValueError: ' || set_name AS error FROM result WHERE status = 'bad_dump')
SELECT r.* REPLACE (CASE WHEN f.error IS NULL THEN status ELSE 'error' END AS status, coalesce(f.error, note) AS note)
FROM result r LEFT JOIN failed f ON f.collection = r.collection AND f.file_name = r.file_name""")
def error_rows(spark, d):
    rows = fr.results(spark, d)
    failed = rows.filter("status = 'bad_dump'").select("collection", "file_name", F.concat(F.lit("ValueError: "), "set_name").alias("error"))
    return RS.mark_errors(rows, failed)


# ---- regions ----
PREFER = ["USA", "World", "Japan"]


def _rank(c):
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{p.lower()}') THEN {i}" for i, p in enumerate(PREFER)) + f" ELSE {len(PREFER)} END"


SQL_REGION = rf"""regional AS (SELECT *, min(region_rank) OVER (PARTITION BY collection, title) AS best FROM (
  SELECT collection, file_name, set_name, trim(regexp_extract(set_name, '^([^(]+)', 1)) AS title,
    {_rank("regexp_extract(set_name, '[(]([^)]+)[)]', 1)")} AS region_rank FROM result WHERE status = 'matched'))"""


@query("region_exclusions", RESULTS + f", {SQL_REGION} SELECT collection, file_name, set_name, region_rank, region_rank > best OR best >= 3 AS excluded FROM regional")
def region_exclusions(spark, d):
    matched = fr.results(spark, d).filter("status = 'matched'").select("collection", "file_name", "set_name")
    return RG.region_exclusions(matched, PREFER)


# ---- queue: what is settled is queued, the rest is offered ----
_QUEUE = f""", queue AS (SELECT collection, file_name, CASE WHEN p_size % 8 = 5 THEN '' ELSE title END AS set_name, row_pos AS queue_pos, status <> 'matched' AS is_new FROM (
  SELECT r.*, p.p_size, p.p_name || ' (' || {fr.REGION} || ')' AS title FROM result r JOIN part p ON p.p_partkey = r.row_pos WHERE r.file_name IS NOT NULL)),
pool AS (SELECT *, CASE WHEN set_name = '' THEN file_name ELSE set_name END AS name FROM queue),
won AS (SELECT collection, name, file_name AS winner FROM (SELECT *, row_number() OVER (PARTITION BY collection, name ORDER BY {_rank('name')}, queue_pos) AS rn FROM pool) WHERE rn = 1)"""


def _queue(spark, d):
    return fr.table(spark, d, "part").selectExpr(
        "p_type AS collection", f"{fr.RESULT['file_name']} AS file_name",
        f"CASE WHEN p_size % 8 = 5 THEN '' ELSE p_name || ' (' || {fr.REGION} || ')' END AS set_name",
        "p_partkey AS queue_pos", f"{fr.RESULT['status']} <> 'matched' AS is_new").filter("file_name IS NOT NULL")


query("one_file_per_set", RESULTS + _QUEUE + """
SELECT q.collection, q.file_name, q.set_name, q.queue_pos, q.is_new FROM queue q WHERE EXISTS (SELECT 1 FROM won w WHERE w.collection = q.collection AND w.winner = q.file_name)""")(
    lambda spark, d: RG.one_file_per_set(_queue(spark, d), PREFER))
query("queue_conflicts", RESULTS + _QUEUE + """
SELECT p.collection, p.name AS kept, w.winner AS kept_file, p.file_name AS dropped_file FROM pool p JOIN won w ON w.collection = p.collection AND w.name = p.name
WHERE w.winner <> p.file_name AND p.is_new""")(lambda spark, d: RG.queue_conflicts(_queue(spark, d), PREFER))
query("new_queue_items", RESULTS + """
SELECT collection, file_name FROM result r WHERE file_name IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM result q WHERE q.status = 'matched' AND q.collection = r.collection AND q.file_name = r.file_name)""")(
    lambda spark, d: RG.new_items(
        fr.results(spark, d).filter("file_name IS NOT NULL").select("collection", "file_name"),
        fr.results(spark, d).filter("status = 'matched'")))


# ---- routing: all files are asked for, and as many that never had a row; files of one brand are gone from disk ----
_DISK = f"CASE p_brand WHEN 'Brand#5' THEN 'gone-' || CAST(p_partkey AS STRING) ELSE {fr.RESULT['file_name']} END"
_ASK = f""", asked AS (SELECT collection, file_name FROM result WHERE file_name IS NOT NULL
  UNION SELECT p_type, 'new-' || CAST(p_partkey AS STRING) FROM part),
disk AS (SELECT p_type AS collection, {_DISK} AS file_name FROM part),
routed AS (SELECT a.collection, a.file_name, CASE WHEN r.status = 'matched' THEN r.set_name END AS set_name,
  CASE WHEN g.region_rank > g.best OR g.best >= 3 THEN 'excluded' WHEN r.status IS NULL THEN 'failed' WHEN r.status <> 'matched' AND r.plan = 'exclude' THEN 'excluded'
    WHEN r.status = 'duplicate' THEN 'duplicate' WHEN r.status <> 'matched' THEN 'failed' WHEN r.plan = 'exclude' THEN 'excluded' WHEN k.file_name IS NULL THEN 'failed' ELSE 'export' END AS outcome,
  CASE WHEN g.region_rank > g.best OR g.best >= 3 THEN 'Region-excluded (prefer USA, World, Japan)' WHEN r.status IS NULL THEN 'Not in database — run Scan first'
    WHEN r.status <> 'matched' AND r.plan = 'exclude' THEN 'Excluded' WHEN r.status = 'duplicate' THEN 'Skipped (duplicate)'
    WHEN r.status = 'unmatched' THEN 'Skipped (no CRC match in DAT (fan translation, hack, or bad dump))' WHEN r.status IN ('unverified', 'ok') THEN 'Skipped (run Analyze first)'
    WHEN r.status <> 'matched' THEN 'Skipped (status: ' || r.status || ')' WHEN r.plan = 'exclude' THEN 'Excluded' WHEN k.file_name IS NULL THEN 'File not found on disk' ELSE '' END AS reason
  FROM asked a LEFT JOIN result r ON r.collection = a.collection AND r.file_name = a.file_name
  LEFT JOIN regional g ON g.collection = a.collection AND g.file_name = a.file_name
  LEFT JOIN disk k ON k.collection = a.collection AND k.file_name = a.file_name)"""


def _routed(spark, d):
    rows = fr.results(spark, d)
    part = fr.table(spark, d, "part")
    fresh = part.selectExpr("p_type AS collection", "'new-' || CAST(p_partkey AS STRING) AS file_name")
    asked = rows.filter("file_name IS NOT NULL").select("collection", "file_name").unionByName(fresh)
    disk = part.selectExpr("p_type AS collection", f"{_DISK} AS file_name")
    return RT.route(asked, rows, disk, PREFER)


query("export_routing", RESULTS + f", {SQL_REGION}" + _ASK + "SELECT * FROM routed")(_routed)
query("export_outcomes", RESULTS + f", {SQL_REGION}" + _ASK + "SELECT collection, outcome, count(*) AS n_files FROM routed GROUP BY ALL")(
    lambda spark, d: RT.outcome_summary(_routed(spark, d)))
