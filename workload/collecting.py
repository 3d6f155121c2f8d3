"""Collections, catalogues and source lists over supplier and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import dispatch as D
from shelfmark.functions import tables as T
from shelfmark.operators import collections as CO
from shelfmark.operators import precheck as P
from shelfmark.operators import views as V
from shelfmark.sources import registry as R
from workload import frames as fr
from workload.frames import COLLECTIONS
from workload.naming import SQL_ALIAS
from workload.registry import query

_PREFIXES = ", ".join(f"'{p}'" for p in T.SOURCE_PREFIXES)


def _vendor(c):
    return f"CASE WHEN strpos({c}, ' - ') > 0 THEN trim(split_part({c}, ' - ', 1)) ELSE '' END"


def _rest(c):
    return f"CASE WHEN strpos({c}, ' - ') > 0 THEN trim(substr({c}, strpos({c}, ' - ') + 3)) ELSE trim({c}) END"


_APART = "va <> '' AND vb <> '' AND va <> vb"
_GO_A = f"{_APART} AND va IN ({_PREFIXES}) AND strpos(ra, ' - ') > 0"
_GO_B = f"{_APART} AND NOT (va IN ({_PREFIXES}) AND strpos(ra, ' - ') > 0) AND vb IN ({_PREFIXES}) AND strpos(rb, ' - ') > 0"
_STRIP = f""", stripped(catalog_name, collection, va, ra, vb, rb) AS (SELECT * FROM p0 UNION ALL
  SELECT catalog_name, collection, CASE WHEN {_GO_A} THEN {_vendor('ra')} ELSE va END, CASE WHEN {_GO_A} THEN {_rest('ra')} ELSE ra END,
  CASE WHEN {_GO_B} THEN {_vendor('rb')} ELSE vb END, CASE WHEN {_GO_B} THEN {_rest('rb')} ELSE rb END
  FROM stripped WHERE ({_GO_A}) OR ({_GO_B})),
last_form AS (SELECT * FROM stripped WHERE NOT (({_GO_A}) OR ({_GO_B})))"""

_BARE = r"trim(regexp_replace({c}, '\s*\([^)]*\)', '', 'g'))"
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace({c}, '\b(?:the|of|and|for)\b', '', 'g'), '[\s\-/]+'), lambda t: length(t) > 1))"
SCORES = COLLECTIONS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {SQL_ALIAS},
p0 AS (SELECT a.catalog_name, b.collection, {_vendor('lower(a.catalog_name)')} AS va, {_rest('lower(a.catalog_name)')} AS ra,
  {_vendor('lower(b.collection)')} AS vb, {_rest('lower(b.collection)')} AS rb
  FROM (SELECT DISTINCT catalog_name FROM catalog_row) a, (SELECT DISTINCT collection FROM directory_row) b){_STRIP},
bare AS (SELECT catalog_name, collection, va <> '' AND vb <> '' AND va <> vb AS apart, {_BARE.format(c='ra')} AS x, {_BARE.format(c='rb')} AS y FROM last_form),
tok AS (SELECT bare.*, {_TOKENS.format(c='x')} AS tx, {_TOKENS.format(c='y')} AS ty, ax.canon AS cx, ay.canon AS cy
  FROM bare LEFT JOIN alias ax ON ax.spelling = x LEFT JOIN alias ay ON ay.spelling = y),
cnt AS (SELECT *, len(list_intersect(tx, ty)) AS common, least(len(tx), len(ty)) AS fewest, len(list_distinct(list_concat(tx, ty))) AS total FROM tok),
score AS (SELECT catalog_name, collection, CASE WHEN apart THEN 0 WHEN x = y THEN 100 WHEN cx = cy THEN 90 WHEN contains(x, y) OR contains(y, x) THEN 80
  WHEN common > 0 AND common::DOUBLE / fewest >= 0.5 THEN common::DOUBLE / total * 70 ELSE 0 END::DOUBLE AS score FROM cnt)
"""

query("collection_scores", SCORES + "SELECT catalog_name, collection, round(score, 6) AS score FROM score WHERE score > 0")(
    lambda spark, d: CO.collection_scores(fr.catalogs(spark, d), fr.directories(spark, d)).withColumn("score", F.round("score", 6)))


@query("best_collection", SCORES + """
SELECT catalog_name, collection, round(score, 6) AS score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY catalog_name ORDER BY score DESC, pos) AS rn
  FROM score s JOIN (SELECT collection, min(pos) AS pos FROM directory_row GROUP BY ALL) d ON d.collection = s.collection WHERE score > 0) WHERE rn = 1""")
def best_collection(spark, d):
    return CO.best_collection(fr.catalogs(spark, d), fr.directories(spark, d)).withColumn("score", F.round("score", 6))


@query("catalogs_for_collections", SCORES + """
SELECT s.catalog_name, s.collection, round(s.score, 6) AS score, c.catalog_path FROM score s JOIN catalog_row c ON c.catalog_name = s.catalog_name WHERE score >= 1""")
def catalogs_for_collections(spark, d):
    return CO.catalogs_for_collections(fr.catalogs(spark, d), fr.directories(spark, d)).withColumn("score", F.round("score", 6))


@query("ranked_collection_matches", SCORES + """
SELECT catalog_name, collection, round(score, 6) AS score, row_number() OVER (PARTITION BY collection ORDER BY score DESC, pos) AS match_rank
FROM (SELECT s.*, c.pos FROM score s JOIN (SELECT catalog_name, min(pos) AS pos FROM catalog_row GROUP BY ALL) c ON c.catalog_name = s.catalog_name WHERE score >= 1)""")
def ranked_collection_matches(spark, d):
    return CO.ranked_matches(fr.catalogs(spark, d), fr.directories(spark, d)).select(
        "catalog_name", "collection", F.round("score", 6).alias("score"), F.col("match_rank").cast("bigint").alias("match_rank"))


# ---- lookups by substring of the collection name ----
def _case(table, c, policy):
    items = list(table.items()) if policy == "first" else sorted(table.items(), key=lambda kv: -len(kv[0]))
    whens = " ".join(f"WHEN contains(lower({c}), '{k.lower()}') THEN '{' '.join(v)}'" for k, v in items)
    return f"CASE {whens} END"


@query("collection_dispatch", COLLECTIONS + f"""
SELECT catalog_path, {_case(T.MEMBER_TYPES, 'catalog_name', 'first')} AS first_types, {_case(T.MEMBER_TYPES, 'catalog_name', 'longest')} AS longest_types,
       coalesce({_case(T.PLAN_RULES, 'catalog_name', 'longest')}, '{' '.join(T.DEFAULT_RULES)}') AS rules, contains(lower(catalog_name), 'nintendo 64') AS swaps
FROM catalog_row""")
def collection_dispatch(spark, d):
    name = F.col("catalog_name")
    return fr.catalogs(spark, d).select(
        "catalog_path", F.array_join(D.accepted_types(name), " ").alias("first_types"),
        F.array_join(D.accepted_types(name, longest=True), " ").alias("longest_types"),
        F.array_join(D.plan_rules(name), " ").alias("rules"), D.swaps_bytes(name).alias("swaps"))


# ---- source lists ----
_SRC = """, catalog_source AS (SELECT catalog_path AS path, catalog_name AS collection FROM catalog_row),
known AS (SELECT DISTINCT collection FROM directory_row)"""


def _catalog_source(spark, d):
    return fr.catalogs(spark, d).selectExpr("catalog_path AS path", "catalog_name AS collection")


query("source_list", COLLECTIONS + _SRC + """
SELECT DISTINCT path, collection FROM (SELECT path, collection FROM catalog_source UNION ALL SELECT path, collection FROM directory_row)""")(
    lambda spark, d: R.sources(_catalog_source(spark, d), fr.directories(spark, d)))
query("collections_with_new", COLLECTIONS + _SRC + """
SELECT collection FROM known UNION SELECT collection FROM catalog_source""")(
    lambda spark, d: R.with_new_collections(
        fr.directories(spark, d).select("collection").distinct(), _catalog_source(spark, d), fr.directories(spark, d)))
query("catalog_collections", COLLECTIONS + "SELECT DISTINCT catalog_name AS collection FROM catalog_row")(
    lambda spark, d: R.catalog_collections(_catalog_source(spark, d)))
query("same_collection_pairs", COLLECTIONS + _SRC + """
SELECT c.collection, c.path AS catalog_path, f.path AS directory_path FROM catalog_source c JOIN directory_row f ON f.collection = c.collection""")(
    lambda spark, d: P.same_collection(_catalog_source(spark, d), fr.directories(spark, d)))
query("collections_in_order", COLLECTIONS + "SELECT collection, min(pos) AS first_pos FROM directory_row GROUP BY collection")(
    lambda spark, d: V.first_seen(fr.directories(spark, d), ["collection"], "pos"))
query("kept_collections", COLLECTIONS + _SRC + """, every AS (SELECT collection FROM known UNION SELECT collection FROM catalog_source UNION SELECT c_mktsegment FROM customer)
SELECT collection FROM every WHERE collection IN (SELECT collection FROM known) OR collection IN (SELECT collection FROM catalog_source)""")(
    lambda spark, d: V.drop_stale(
        R.with_new_collections(fr.directories(spark, d).select("collection").distinct(), _catalog_source(spark, d)).unionByName(
            fr.table(spark, d, "customer").selectExpr("c_mktsegment AS collection").distinct()),
        _catalog_source(spark, d), fr.directories(spark, d)))
