"""Real files made from the given tables under the shared folder, read back by sources and written by sinks."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.functions import binary as B
from shelfmark.plans import writer as W
from shelfmark.sources import catalogs as CA
from shelfmark.sources import inventory as IN
from workload import frames as fr
from workload.registry import SQL, query


def _put(rows: DataFrame, root: str) -> str:
    """Write (path, content) rows as files under ``root``; a task that runs again writes the same files."""
    base = W.local_path(root)

    def run(batches):
        made = set()
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                full = os.path.join(base, path)
                if os.path.dirname(full) not in made:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    made.add(os.path.dirname(full))
                with open(full, "wb") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    rows.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return root


#: documents whose files share a shelf: more data make more folders, not larger ones, and Spark lists many folders by many tasks
SHELVED = 4000
_FOLDERS = "*/*"


def _doc_shelf(spark, d) -> str:
    """Every document as a loose file in a folder of its collection: shelf, collection, file."""
    shelf = F.expr(f"CAST(regexp_extract(file_name, '[0-9]+', 0) AS BIGINT) DIV {SHELVED}").cast("string")
    rows = fr.doc_files(spark, d).select(F.concat_ws("/", shelf, "collection", "file_name").alias("path"), "content")
    return _put(rows, session.scratch(spark, "shelf"))


def _doc_list(spark, d) -> DataFrame:
    return IN.list_files(spark, *[f"{_doc_shelf(spark, d)}/{_FOLDERS}"])


query("listed_files", fr.DOCS + "SELECT collection, file_name, CAST(octet_length(content) AS BIGINT) AS size FROM doc_file")(
    lambda spark, d: _doc_list(spark, d).select("collection", "file_name", "size"))


@query("read_back_contents", fr.DOCS + "SELECT collection, file_name, md5(content) AS digest FROM doc_file")
def read_back_contents(spark, d):
    return IN.read_contents(spark, f"{_doc_shelf(spark, d)}/{_FOLDERS}").select("collection", "file_name", F.md5("content").alias("digest"))


def _only_spark(spark, path: str) -> str:
    """The same folder under a path that only Spark's readers can open."""
    name = f"shelf{uuid.uuid4().hex[:12]}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", path if ":" in path else f"file://{path}")
    return f"viewfs://{name}/in"


def _held(got: DataFrame, files: DataFrame) -> DataFrame:
    """Readings, each hash held against the one computed from the table."""
    cut = F.when(F.col("prefix").isNull(), F.col("content")).otherwise(F.expr("substring(content, prefix + 1)"))
    return got.join(files, ["collection", "file_name"]).select(
        "collection", "file_name", "kind", "prefix", "size", (F.col("hash") == F.lpad(F.lower(F.hex(F.crc32(cut))), 8, "0")).alias("same"))


# every reading of every file; a file that couldn't be read, or read in a byte order it isn't in, would be a row too many
_READINGS = fr.DOCS + """
SELECT collection, file_name, 'raw' AS kind, CAST(NULL AS INT) AS prefix, CAST(octet_length(content) AS BIGINT) AS size, true AS same FROM doc_file
UNION ALL SELECT collection, file_name, kind, prefix, size, true FROM doc_variant"""


@query("streamed_readings", _READINGS)
def streamed_readings(spark, d):
    return _held(IN.streamed_variants(_doc_list(spark, d)), fr.doc_files(spark, d))


# in the smallest pieces there are, so that long documents are read by several tasks
@query("split_readings", _READINGS)
def split_readings(spark, d):
    return _held(IN.split_variants(_doc_list(spark, d), piece=8192), fr.doc_files(spark, d))


@query("any_store_readings", _READINGS)
def any_store_readings(spark, d):
    files = IN.read_contents(spark, f"{_only_spark(spark, _doc_shelf(spark, d))}/{_FOLDERS}")
    return _held(IN.streamed_variants(files), fr.doc_files(spark, d))


query("any_store_files", fr.DOCS + "SELECT collection, file_name, CAST(octet_length(content) AS BIGINT) AS size FROM doc_file")(
    lambda spark, d: IN.list_files(spark, f"{_only_spark(spark, _doc_shelf(spark, d))}/{_FOLDERS}").select("collection", "file_name", "size"))


# ---- packages: one archive a conversation, one member a turn ----
_TURN = "'turn-' || lpad(CAST(turn AS STRING), 4, '0') || '.txt'"


#: packages a folder: more data make more folders, not larger ones
PACKED = 1000
_SHELF = "^[0-9]+ "


def _packages(spark, d) -> tuple[DataFrame, str]:
    """A package a conversation, in folders of its shelf and collection."""
    turns = fr.table(spark, d, "conversations").selectExpr(
        f"CAST(conv_id DIV {PACKED} AS STRING) || ' ' || {fr.CONV_COLLECTION} AS collection", "'conv-' || CAST(conv_id AS STRING) AS set_name", "CAST(turn AS INT) AS entry_pos", f"{_TURN} AS entry_name", "text")
    where = F.concat_ws("/", "collection", "set_name", "entry_name")
    root = _put(turns.select(where.alias("path"), F.encode("text", "UTF-8").alias("content")), session.scratch(spark, "turns"))
    dest = session.scratch(spark, "packages")
    entries = turns.select("collection", "set_name", "entry_pos", "entry_name", F.concat(F.lit(root + "/"), where).alias("source_path"), F.lit(None).cast("string").alias("member_name"))
    return session.cut(W.write_sets(entries, W.local_path(dest))), dest


def _unshelved(rows: DataFrame) -> DataFrame:
    return rows.withColumn("collection", F.regexp_replace("collection", _SHELF, ""))


@query("rebuilt_packages", f"""SELECT {fr.CONV_COLLECTION} AS collection, 'conv-' || CAST(conv_id AS VARCHAR) AS file_name, 'conv-' || CAST(conv_id AS VARCHAR) || '.zip' AS target_name,
  CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS error FROM conversations GROUP BY conv_id""")
def rebuilt_packages(spark, d):
    return _unshelved(_packages(spark, d)[0])


@query("packaged_members", f"""SELECT {fr.CONV_COLLECTION} AS collection, 'conv-' || CAST(conv_id AS VARCHAR) || '.zip' AS file_name, {_TURN.replace('STRING', 'VARCHAR')} AS member_name,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS member_pos, CAST(strlen(text) AS BIGINT) AS size FROM conversations""")
def packaged_members(spark, d):
    _, dest = _packages(spark, d)
    return _unshelved(IN.list_members(IN.list_files(spark, f"{dest}/*"))).select("collection", "file_name", "member_name", "member_pos", "size")


query("any_store_members", SQL["packaged_members"])(
    lambda spark, d: _unshelved(IN.list_members(IN.read_contents(spark, f"{_only_spark(spark, _packages(spark, d)[1])}/*"))).select("collection", "file_name", "member_name", "member_pos", "size"))


def _jobs(files: DataFrame, target, **steps) -> DataFrame:
    """An export job a file, with the steps given as columns."""
    none = F.lit(None).cast("string")
    every = {"n_steps": F.lit(0), "strip_bytes": F.lit(0).cast("bigint"), "inner_name": none, "from_fmt": none, "to_fmt": none, "new_ext": none, **steps}
    return files.select("collection", "file_name", F.col("collection").alias("catalog"), F.col("path").alias("source_path"), target.alias("target_name"),
                        *[v.alias(k) for k, v in every.items()], *[c for c in ("content",) if c in files.columns])


_EXPORTED = fr.DOCS + """
SELECT collection, file_name, 'out-' || file_name AS target_name, CAST(octet_length(content) AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS error FROM doc_file"""


@query("exported_files", _EXPORTED)
def exported_files(spark, d):
    return W.write_exports(_jobs(_doc_list(spark, d), F.concat(F.lit("out-"), "file_name")), W.local_path(session.scratch(spark, "exports")))


@query("any_store_exports", _EXPORTED)
def any_store_exports(spark, d):
    files = IN.read_contents(spark, f"{_only_spark(spark, _doc_shelf(spark, d))}/{_FOLDERS}")
    return W.write_exports(_jobs(files, F.concat(F.lit("out-"), "file_name")), W.local_path(session.scratch(spark, "exports")))


# a third loses its first 16 bytes, a third is packed, a third changes its byte order inside a package; all are read back and held against the table
@query("exported_with_steps", fr.DOCS + """
SELECT collection, file_name, 'out-' || file_name || CASE WHEN step = 0 THEN '' ELSE '.zip' END AS target_name,
  CAST(octet_length(content) - CASE WHEN step = 0 THEN least(16, octet_length(content)) ELSE 0 END AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS error, true AS same
FROM (SELECT *, octet_length(content) % 3 AS step FROM doc_file)""")
def exported_with_steps(spark, d):
    files = _doc_list(spark, d)
    step, none = F.col("size") % 3, F.lit(None).cast("string")
    jobs = _jobs(
        files, F.concat(F.lit("out-"), "file_name", F.when(step == 0, "").otherwise(".zip")), n_steps=F.lit(1), strip_bytes=F.when(step == 0, 16).otherwise(0).cast("bigint"),
        inner_name=F.when(step > 0, F.concat("file_name", F.lit(".old"))), from_fmt=F.when(step == 2, "byteswapped").otherwise(none),
        to_fmt=F.when(step == 2, "bigendian").otherwise(none), new_ext=F.when(step == 2, ".new").otherwise(none))
    dest = session.scratch(spark, "exports")
    manifest = session.cut(W.write_exports(jobs, W.local_path(dest), convert=True))
    # listed once
    back = IN.list_files(spark, f"{dest}/*")
    packed = IN.list_members(back).select(F.col("file_name").alias("target_name"), "member_name", "crc")
    loose = IN.with_contents(back.where("file_name NOT LIKE '%.zip'")).select(F.col("file_name").alias("target_name"), none.alias("member_name"), B.digest(F.col("content")).alias("crc"))
    want = fr.doc_files(spark, d).withColumn("size", F.octet_length("content")).select("collection", "file_name", F.when(step > 0, F.concat("file_name", F.when(step == 2, ".new").otherwise(".old"))).alias("inner"),
        B.digest(F.when(step == 0, F.expr("substring(content, 17)")).when(step == 2, B.swap_bytes(F.col("content"), "byteswapped")).otherwise(F.col("content"))).alias("hash"))
    same = (F.col("crc") == F.col("hash")) & F.col("member_name").eqNullSafe(F.col("inner"))
    # what is left of a file may be empty: Spark's sources leave such files out
    same = F.coalesce(same, F.col("bytes") == 0)
    return manifest.join(packed.union(loose), "target_name", "left").join(want, ["collection", "file_name"]).select("collection", "file_name", "target_name", "bytes", "error", same.alias("same"))


# ---- catalogues: one a nation and range of supplier numbers, a set a supplier, plain and zipped ----
#: suppliers a catalogue may list: more data make more catalogues, not larger ones
LISTED = 500


def _catalog_files(spark, d) -> str:
    game = F.format_string('<game name="%s"><description>%s</description><rom name="%s.bin" size="%d" crc="%s"/></game>', "s_name", "s_name", "s_name", F.col("s_suppkey"), F.substring(F.md5("s_name"), 1, 8))
    named = fr.table(spark, d, "supplier").join(fr.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = named.withColumn("n_name", F.expr(f"n_name || ' ' || CAST(s_suppkey DIV {LISTED} AS STRING)"))
    rows = named.groupBy("n_name").agg(F.array_join(F.sort_array(F.collect_list(game)), "").alias("games")).select(
        "n_name", F.concat(F.lit("<datafile><header><name>"), "n_name", F.lit("</name><version>1</version></header>"), "games", F.lit("</datafile>")).alias("xml"))

    def zipped(batches):
        for pdf in batches:
            out = []
            for xml in pdf["xml"]:
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("list.dat", xml)
                out.append(raw.getvalue())
            yield pd.DataFrame({"path": pdf["n_name"] + ".zip", "content": out})

    plain = rows.select(F.concat("n_name", F.lit(".dat")).alias("path"), F.encode("xml", "UTF-8").alias("content"))
    return _put(plain.union(rows.mapInPandas(zipped, "path string, content binary")), session.scratch(spark, "catalogues"))


_LIST = f"n_name || ' ' || CAST(s_suppkey // {LISTED} AS VARCHAR)"
_ENTRIES = f"SELECT {_LIST} AS catalog, s_name AS set_name, s_name || '.bin' AS entry_name, CAST(s_suppkey AS BIGINT) AS size, substr(md5(s_name), 1, 8) AS crc FROM supplier JOIN nation ON n_nationkey = s_nationkey"
_OF = r"regexp_extract(catalog_path, '([^/]+)[.](dat|zip)$', 1) AS catalog"


@query("plain_catalog_entries", _ENTRIES)
def plain_catalog_entries(spark, d):
    return CA.read_entries(spark, _catalog_files(spark, d)).selectExpr(_OF, "set_name", "entry_name", "size", "crc")


@query("zipped_catalog_entries", _ENTRIES)
def zipped_catalog_entries(spark, d):
    return CA.read_zipped_entries(spark, _catalog_files(spark, d)).selectExpr(_OF, "set_name", "entry_name", "size", "crc")


@query("discovered_catalogs", f"""SELECT DISTINCT g AS catalog_group, {_LIST} AS name, {_LIST} AS collection, '1' AS version
FROM supplier JOIN nation ON n_nationkey = s_nationkey, (VALUES (0), (1)) t(g)""")
def discovered_catalogs(spark, d):
    return CA.discover_catalogs(spark, _catalog_files(spark, d)).select("catalog_group", "name", "collection", "version")
