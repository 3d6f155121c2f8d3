"""Whole runs over real files: a shelf of folders and catalogues made from the documents, scanned, checked, analysed and exported."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.plans import runs
from shelfmark.plans import writer as W
from workload import frames as fr
from workload.filing import _put
from workload.registry import query

#: documents a collection; every fifth has no file, every seventh no entry
HELD = 400
_NAME = "'doc-' || lpad(CAST(doc_id AS {text}), 8, '0')"

SHELF = f"""WITH doc AS (SELECT 'k' || substr(md5(CAST(doc_id // {HELD} AS VARCHAR)), 1, 10) AS collection, {_NAME.format(text='VARCHAR')} AS set_name, doc_id, 'text: ' || coalesce(text, '') AS held,
  strlen('text: ' || coalesce(text, '')) AS n FROM documents),
file AS (SELECT collection, set_name || '.txt' AS file_name, held, n FROM doc WHERE doc_id % 5 <> 0),
entry AS (SELECT collection, set_name, set_name || '.txt' AS entry_name, held FROM doc WHERE doc_id % 7 <> 0),
first AS (SELECT collection, held, min(set_name) AS set_name, min(entry_name) AS entry_name FROM entry GROUP BY ALL)
"""


def _shelf(spark, d) -> runs.Shelf:
    held = F.encode(F.concat(F.lit("text: "), F.coalesce("text", F.lit(""))), "UTF-8")
    docs = fr.table(spark, d, "documents").select(
        "doc_id", F.expr(f"'k' || substr(md5(CAST(doc_id DIV {HELD} AS STRING)), 1, 10)").alias("collection"), F.expr(_NAME.format(text="STRING")).alias("name"), held.alias("content"))
    files = _put(docs.where("doc_id % 5 <> 0").select(F.format_string("%s/%s.txt", "collection", "name").alias("path"), "content"), session.scratch(spark, "files"))
    game = F.format_string('<game name="%s"><description>%s</description><rom name="%s.txt" size="%d" crc="%s"/></game>',
                           "name", "name", "name", F.octet_length("content"), F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0"))
    lists = docs.where("doc_id % 7 <> 0").groupBy("collection").agg(F.array_join(F.sort_array(F.collect_list(game)), "").alias("games"))
    xml = F.concat(F.lit("<datafile><header><name>"), "collection", F.lit("</name><version>1</version></header>"), "games", F.lit("</datafile>"))
    catalogs = _put(lists.select(F.concat("collection", F.lit(".dat")).alias("path"), F.encode(xml, "UTF-8").alias("content")), session.scratch(spark, "lists"))
    return runs.open_shelf(spark, catalogs, f"{files}/*")


@query("scan_run", SHELF + """SELECT collection, set_name, CASE WHEN EXISTS (SELECT 1 FROM file f WHERE f.collection = e.collection AND f.held = e.held) THEN 'ok' ELSE 'missing' END AS status FROM entry e""")
def scan_run(spark, d):
    return runs.scan(_shelf(spark, d))[0].select("collection", "set_name", "status")


@query("scan_run_unmatched", SHELF + "SELECT collection, file_name FROM file f WHERE NOT EXISTS (SELECT 1 FROM entry e WHERE f.collection = e.collection AND f.held = e.held)")
def scan_run_unmatched(spark, d):
    return runs.scan(_shelf(spark, d))[1].select("collection", "file_name")


@query("name_check_run", SHELF + """SELECT e.collection, e.set_name, coalesce(f.file_name, '') AS file_name, CASE WHEN f.file_name IS NULL THEN 'missing' ELSE 'unverified' END AS status
  FROM entry e LEFT JOIN file f ON f.collection = e.collection AND f.file_name = e.entry_name
UNION ALL SELECT collection, '', file_name, 'unmatched' FROM file f WHERE NOT EXISTS (SELECT 1 FROM entry e WHERE e.collection = f.collection AND e.entry_name = f.file_name)""")
def name_check_run(spark, d):
    _, rows = runs.check_names(_shelf(spark, d))
    return rows.select("collection", F.when(F.col("status") == "unmatched", "").otherwise(F.col("set_name")).alias("set_name"), F.coalesce("file_name", F.lit("")).alias("file_name"), "status")


@query("analysis_run", SHELF + "SELECT f.collection, file_name, set_name FROM file f JOIN first USING (collection, held)")
def analysis_run(spark, d):
    return runs.analyse(_shelf(spark, d)).where("status = 'matched'").select("collection", "file_name", "set_name")


@query("export_run", SHELF + """, job AS (SELECT f.collection, file_name, set_name || '.zip' AS target_name, n, max(file_name) OVER (PARTITION BY f.collection, set_name) AS last FROM file f JOIN first USING (collection, held))
SELECT collection, file_name, target_name, CASE WHEN file_name = last THEN n::BIGINT END AS bytes, CASE WHEN file_name <> last THEN 'replaced by ' || last END AS error FROM job""")
def export_run(spark, d):
    shelf = _shelf(spark, d)
    return runs.export(shelf, runs.analyse(shelf), W.local_path(session.scratch(spark, "out")))
