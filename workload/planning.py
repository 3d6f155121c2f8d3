"""Export plans for one file per part; archive members from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import tables as T
from shelfmark.plans import rules as R
from shelfmark.session import cut
from workload import frames as fr
from workload.registry import query

SYSTEMS = ["Nintendo - Nintendo 64", "Sony - PlayStation 2", "Sony - PlayStation", "Nintendo - Super Nintendo"]
_SYS = fr._pick("p_size % 4", SYSTEMS)
_SRC = fr._pick("p_size % 5", [".z64", ".v64", ".smc", ".iso", ".nes"])
_ENT = fr._pick("p_size % 3", [".z64", ".sfc", ".bin"])
JOB = {
    "collection": _SYS, "catalog": _SYS, "partkey": "p_partkey",
    "file_name": f"{fr.STEM} || '-' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 2 = 0 THEN '.zip' ELSE {_SRC} END",
    "set_name": fr.SET_NAME, "entry_name": f"{fr.SET_NAME} || {_ENT}", "source_type": _SRC,
    "size": f"CAST(p_size * 1024 + CASE WHEN p_size % 7 = 0 THEN 100 WHEN p_size % 5 = 4 THEN 16 ELSE 512 END AS BIGINT)",
    "order_found": "CASE p_size % 6 WHEN 0 THEN 'bigendian' WHEN 1 THEN 'byteswapped' WHEN 2 THEN 'littleendian' END",
    "zero_512": "CAST(60 + p_size AS INT)", "zero_16": "CAST(50 + p_size AS INT)",
    "readable": "p_brand <> 'Brand#9'",
}
_MEMBER_NAME = "'m-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || CASE l_returnflag WHEN 'A' THEN '.z64' WHEN 'N' THEN '.sfc' ELSE '.txt' END"


def _jobs(spark, d):
    return fr.table(spark, d, "part").selectExpr(*fr._columns(JOB)).withColumn(
        "zero_pct", F.create_map(F.lit(512), "zero_512", F.lit(16), "zero_16"))


def _members(spark, d):
    rows = fr.table(spark, d, "lineitem").selectExpr(
        "l_partkey AS partkey", "CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS member_pos", f"{_MEMBER_NAME} AS member_name")
    return rows.join(_jobs(spark, d).select("partkey", "collection", "file_name"), "partkey").drop("partkey")


_ORDER = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.BYTE_ORDER_BY_TYPE.items()) + " END"
_LABEL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.BYTE_ORDER_LABELS.items()) + " END"
STEPS = f"""WITH job AS (SELECT {', '.join(fr._columns(JOB))} FROM part),
j AS (SELECT *, lower(regexp_extract(entry_name, '[^/](\\.[^./]+)$', 1)) AS ext, {_ORDER.format(c='source_type')} AS src_order,
  CASE source_type WHEN '.smc' THEN 512 WHEN '.nes' THEN 16 END AS n,
  CASE WHEN collection LIKE 'Nintendo%' THEN true ELSE false END AS packs, collection LIKE '%64' AS n64, collection LIKE '%2' AS ps2 FROM job WHERE readable),
j2 AS (SELECT *, {_ORDER.format(c='ext')} AS ext_order, CASE n WHEN 512 THEN zero_512 WHEN 16 THEN zero_16 END AS zeros FROM j),
removed AS (SELECT j2.collection, j2.catalog, j2.file_name, CASE WHEN ps2 THEN 1 ELSE 3 END AS rule_pos, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS sub_pos, {_MEMBER_NAME} AS member_name
  FROM j2 JOIN lineitem ON l_partkey = partkey WHERE file_name LIKE '%.zip' AND (packs OR ps2)
    AND NOT CASE WHEN n64 THEN l_returnflag = 'A' WHEN packs THEN l_returnflag = 'N' ELSE false END),
step AS (
  SELECT collection, catalog, file_name, 1 AS rule_pos, 0 AS sub_pos, 'strip_header' AS name,
    'Strip ' || CAST(n AS VARCHAR) || '-byte copier header (' || source_type || ' format, ' || CAST(zeros AS VARCHAR) || '% zeros)' AS description
  FROM j2 WHERE packs AND size > n AND (size - n) % 1024 = 0 AND zeros >= 80
  UNION ALL SELECT collection, catalog, file_name, 2, 0, 'rename_ext', 'Rename extension: ' || source_type || ' → ' || ext
  FROM j2 WHERE packs AND source_type <> ext AND NOT (src_order IS NOT NULL AND ext_order IS NOT NULL)
  UNION ALL SELECT collection, catalog, file_name, rule_pos, sub_pos, 'remove_embedded', 'Remove non-essential embedded file: ' || member_name FROM removed
  UNION ALL SELECT collection, catalog, file_name, 4, 0, 'compress_package', 'Package as: ' || set_name || '.zip containing '
    || CASE WHEN src_order IS NOT NULL AND ext_order IS NOT NULL THEN set_name || source_type ELSE entry_name END FROM j2 WHERE packs
  UNION ALL SELECT collection, catalog, file_name, 5, 0, 'convert_byteorder', 'Convert byte order: ' || {_LABEL.format(c='coalesce(order_found, src_order)')} || ' → ' || {_LABEL.format(c='ext_order')}
  FROM j2 WHERE n64 AND src_order IS NOT NULL AND coalesce(order_found, src_order) <> ext_order
  UNION ALL SELECT collection, catalog, file_name, CASE WHEN ps2 THEN 2 ELSE 1 END, 0, 'loose_file', 'Export as: ' || set_name || source_type FROM j2 WHERE NOT packs)
"""


@query("plan_steps", STEPS + "SELECT collection, catalog, file_name, CAST(rule_pos AS BIGINT) AS rule_pos, CAST(sub_pos AS BIGINT) AS sub_pos, name, description FROM step")
def plan_steps(spark, d):
    return R.plan_steps(_jobs(spark, d), _members(spark, d)).select(
        "collection", "catalog", "file_name", F.col("rule_pos").cast("bigint").alias("rule_pos"), "sub_pos", "name", "description")


@query("removed_members", STEPS + "SELECT collection, file_name, member_name FROM removed")
def removed_members(spark, d):
    return R.embedded_members(_jobs(spark, d), _members(spark, d)).select("collection", "file_name", "member_name")


@query("plan_headers", STEPS + """
SELECT job.collection, job.catalog, job.file_name, job.set_name,
  CASE WHEN p.packs IS NULL THEN job.entry_name WHEN p.packs THEN job.set_name || '.zip' ELSE job.set_name || job.source_type END AS target_name,
  coalesce(s.n, 0) AS n_steps, coalesce(s.summary, 'No changes needed') AS summary, CASE WHEN s.n > 0 THEN 'modify' ELSE 'ok' END AS plan_label
FROM job LEFT JOIN j p ON p.partkey = job.partkey
LEFT JOIN (SELECT file_name, collection, count(*) AS n, string_agg(name, ' → ' ORDER BY rule_pos, sub_pos) AS summary FROM step GROUP BY ALL) s
  ON s.file_name = job.file_name AND s.collection = job.collection""")
def plan_headers(spark, d):
    return R.plan_headers(_jobs(spark, d), _members(spark, d))


@query("target_entries", "WITH " + fr.SQL_PART_SET + """
SELECT collection, catalog, set_name, arg_min(entry_name, set_pos) AS entry_name FROM part_set GROUP BY ALL""")
def target_entries(spark, d):
    return R.target_entries(fr.part_sets(spark, d))


@query("plan_changes", STEPS + "SELECT collection, name, count(*) AS n_files FROM (SELECT DISTINCT collection, file_name, name FROM step) GROUP BY ALL")
def plan_changes(spark, d):
    steps = cut(R.plan_steps(_jobs(spark, d), _members(spark, d)))
    return steps.select("collection", "file_name", "name").distinct().groupBy("collection", "name").agg(F.count(F.lit(1)).alias("n_files"))
