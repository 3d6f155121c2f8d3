"""Archive members: one archive per conversation, one member per turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import dispatch as D
from shelfmark.operators import members as ME
from shelfmark.plans import writer as W
from workload import frames as fr
from workload.frames import MEMBERS
from workload.registry import query

_ACCEPTED = D.accepted_types
FILE = ["collection", "file_name"]
_PRIMARY = MEMBERS + """,
primary_member AS (SELECT collection, file_name, member_name, member_pos, size, crc, substr(ext, 2) AS member_type, n_members FROM (
  SELECT *, row_number() OVER (PARTITION BY collection, file_name ORDER BY coalesce(list_contains(accepted, ext), false) DESC, size DESC, member_pos) AS rn,
         count(*) OVER (PARTITION BY collection, file_name) AS n_members FROM typed) WHERE rn = 1)
"""


@query("accepted_members", MEMBERS + """
SELECT collection, file_name, member_pos, member_name, size, crc FROM (
  SELECT *, coalesce(list_contains(accepted, ext), false) AS ok, bool_or(coalesce(list_contains(accepted, ext), false)) OVER (PARTITION BY collection, file_name) AS any_ok FROM typed)
WHERE ok OR NOT any_ok""")
def accepted_members(spark, d):
    return ME.accepted_members(fr.members(spark, d), _ACCEPTED(F.col("collection")))


def _primary(spark, d):
    return ME.primary_members(fr.members(spark, d), _ACCEPTED(F.col("collection")))


query("primary_members", _PRIMARY + "SELECT * FROM primary_member")(_primary)


@query("member_table", MEMBERS + """
SELECT collection, file_name, CASE WHEN substr(ext, 2) IN ('z64','v64','n64','sfc','smc','nes','gba','gbc','gb','md','smd','bin','iso','chd','cue','img','cdi') THEN 0 ELSE 1 END AS group_ord,
  member_pos, member_name, substr(ext, 2) AS member_type, size, crc FROM typed""")
def member_table(spark, d):
    return ME.member_table(fr.members(spark, d))


@query("extra_members", _PRIMARY + """
SELECT t.collection, t.file_name, t.member_pos, t.member_name FROM typed t JOIN primary_member p ON p.collection = t.collection AND p.file_name = t.file_name
WHERE substr(t.ext, 2) <> p.member_type""")
def extra_members(spark, d):
    return W.extra_members(fr.members(spark, d), _primary(spark, d)).select(*FILE, "member_pos", "member_name")


@query("primary_hashes", _PRIMARY + """, loose AS (
  SELECT collection, file_name, 'whole-' || CAST(count(*) AS VARCHAR) AS hash FROM member GROUP BY ALL
  UNION ALL SELECT 'Homebrew', 'item-' || CAST(item_id AS VARCHAR) || '.txt', md5(text) FROM benchmark)
SELECT l.collection, l.file_name, p.member_name, coalesce(p.crc, l.hash) AS hash FROM loose l LEFT JOIN primary_member p ON p.collection = l.collection AND p.file_name = l.file_name""")
def primary_hashes(spark, d):
    loose = fr.members(spark, d).groupBy(*FILE).agg(F.concat(F.lit("whole-"), F.count(F.lit(1)).cast("string")).alias("hash"))
    items = fr.table(spark, d, "benchmark").selectExpr(
        "'Homebrew' AS collection", "'item-' || CAST(item_id AS STRING) || '.txt' AS file_name", "md5(text) AS hash")
    return ME.file_hashes(loose.unionByName(items), _primary(spark, d))


# catalogues list what the conversations of another kind hold
_TYPES = """, listed AS (SELECT collection, collection || ' list' AS catalog, list_sort(list_distinct(list(
  CASE WHEN ext = CASE collection WHEN 'Sony - PlayStation 2' THEN '.bin' ELSE '.sfc' END THEN '.rom' ELSE ext END))) AS types FROM typed GROUP BY ALL)"""


@query("format_notes", _PRIMARY + _TYPES + """
SELECT p.collection, l.catalog, p.file_name, 'Format note: ROM inside archive is .' || p.member_type || ', DAT expects ' || array_to_string(l.types, ', ')
  || '. May need conversion (e.g. byte-order swap for N64).' AS note
FROM primary_member p JOIN listed l ON l.collection = p.collection
WHERE p.collection <> 'Homebrew' AND p.member_type <> '' AND NOT list_contains(l.types, '.' || p.member_type)""")
def format_notes(spark, d):
    other = F.when(F.col("collection") == "Sony - PlayStation 2", ".bin").otherwise(".sfc")
    entries = fr.members(spark, d).select(
        "collection", F.concat("collection", F.lit(" list")).alias("catalog"),
        F.when(F.col("member_name").endswith(other), "other.rom").otherwise(F.col("member_name")).alias("entry_name"))
    return ME.format_notes(_primary(spark, d), ME.entry_types(entries), _ACCEPTED(F.col("collection")))
