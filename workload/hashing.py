"""Content hashes, hash reconcile and hash candidates over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import binary as B
from shelfmark.functions import names as N
from shelfmark.operators import hash_match as H
from shelfmark.operators import reconcile as R
from shelfmark.sources.inventory import embedded_sha1
from workload import frames as fr
from workload.frames import DOCS
from workload.registry import query

SCOPE = ["collection", "catalog"]


# ---- content expressions ----
@query("file_hashes", f"WITH {fr.SQL_DOC_FILE} SELECT collection, file_name, md5(content) AS md5, sha1(content) AS sha1, "
                      "CAST(octet_length(content) AS BIGINT) AS size FROM doc_file")
def file_hashes(spark, d):
    c = F.col("content")
    return fr.doc_files(spark, d).select(
        "collection", "file_name", B.digest(c, "md5").alias("md5"), B.digest(c, "sha1").alias("sha1"),
        F.octet_length(c).cast("bigint").alias("size"))


def _variants(spark, d):
    return B.content_variants(fr.doc_files(spark, d), ["collection", "file_name"], "md5", zeros=False)


@query("prefix_stripped_hashes", DOCS + "SELECT collection, file_name, prefix, label, hash, size FROM doc_variant")
def prefix_stripped_hashes(spark, d):
    return _variants(spark, d).filter("kind = 'prefix'").select("collection", "file_name", "prefix", "label", "hash", "size")


_ZEROS = "CAST(len(list_filter(range(0, {n}), lambda i: substr(h, CAST(2 * i + 1 AS BIGINT), 2) = '00')) * 100 // {n} AS INT)"


@query("zero_share", f"""
SELECT doc_id, {_ZEROS.format(n=16)} AS zero_16, {_ZEROS.format(n=512)} AS zero_512
FROM (SELECT doc_id, hex(unhex(repeat('00', 14)) || encode(text) || unhex(repeat('00', 512))) AS h FROM documents)""")
def zero_share(spark, d):
    c = F.expr("concat(unhex(repeat('00', 14)), encode(text, 'UTF-8'), unhex(repeat('00', 512)))")
    return fr.table(spark, d, "documents").select("doc_id", c.alias("c")).select(
        "doc_id", B.zero_share(F.col("c"), 16).alias("zero_16"), B.zero_share(F.col("c"), 512).alias("zero_512"))


# the first bytes say which byte order a file is held in
_LEAD = "CASE lang WHEN 'en' THEN '37804012' WHEN 'de' THEN '40123780' WHEN 'fr' THEN '80371240' ELSE '' END"
_SWAP2 = r"unhex(regexp_replace(hex(content), '(..)(..)', '\2\1', 'g'))"
_SWAP4 = r"unhex(regexp_replace(hex(content), '(..)(..)(..)(..)', '\4\3\2\1', 'g'))"
SQL_SWAP = f"""swap_file AS (SELECT doc_id, {fr.DOC_COLLECTION} AS collection, {fr.DOC_NAME} AS file_name,
  unhex({_LEAD}) || encode(text) AS content FROM documents),
swap_entry AS (SELECT collection, collection || '-list' AS catalog, doc_id AS set_pos, 'set of ' || file_name AS set_name,
  CASE substr(hex(content), 1, 4) WHEN '3780' THEN md5({_SWAP2}) WHEN '4012' THEN md5({_SWAP4}) ELSE md5(content) END AS hash FROM swap_file)"""


def _swap_files(spark, d):
    return fr.table(spark, d, "documents").selectExpr(
        "doc_id", f"{fr.DOC_COLLECTION} AS collection", f"{fr.DOC_NAME} AS file_name",
        f"concat(unhex({_LEAD}), encode(text, 'UTF-8')) AS content")


def _swap_entries(spark, d):
    c = F.col("content")
    order = B.byte_order(c)
    hash_ = (
        F.when(order == "byteswapped", F.md5(B.swap_bytes(c, "byteswapped")))
        .when(order == "littleendian", F.md5(B.swap_bytes(c, "littleendian"))).otherwise(F.md5(c)))
    return _swap_files(spark, d).select(
        "collection", F.concat("collection", F.lit("-list")).alias("catalog"), F.col("doc_id").alias("set_pos"),
        F.concat(F.lit("set of "), "file_name").alias("set_name"), F.lit(0).alias("entry_pos"),
        F.col("file_name").alias("entry_name"), F.lit(0).cast("bigint").alias("size"), hash_.alias("hash"))


def _swap_variants(spark, d):
    return B.content_variants(
        _swap_files(spark, d), ["collection", "file_name"], "md5", swap=F.lit(True), prefix_allowed=F.lit(False))


@query("byte_order", f"""WITH {SQL_SWAP} SELECT doc_id,
  CASE substr(hex(content), 1, 4) WHEN '8037' THEN 'bigendian' WHEN '3780' THEN 'byteswapped' WHEN '4012' THEN 'littleendian' END AS byte_order
FROM swap_file""")
def byte_order(spark, d):
    return _swap_files(spark, d).select("doc_id", B.byte_order(F.col("content")).alias("byte_order"))


@query("byte_swaps", f"WITH {SQL_SWAP} SELECT doc_id, md5({_SWAP2}) AS pairs, md5({_SWAP4}) AS groups FROM swap_file")
def byte_swaps(spark, d):
    c = F.col("content")
    return _swap_files(spark, d).select(
        "doc_id", F.md5(B.swap_bytes(c, "byteswapped")).alias("pairs"), F.md5(B.swap_bytes(c, "littleendian")).alias("groups"))


@query("reencode", f"""WITH {SQL_SWAP} SELECT doc_id, CASE substr(hex(content), 1, 4)
  WHEN '3780' THEN md5(unhex(regexp_replace(hex({_SWAP2}), '(..)(..)(..)(..)', '\\4\\3\\2\\1', 'g')))
  WHEN '4012' THEN md5(content) ELSE md5({_SWAP4}) END AS value FROM swap_file""")
def reencode(spark, d):
    c = F.col("content")
    order = F.coalesce(B.byte_order(c), F.lit("bigendian"))
    return _swap_files(spark, d).select("doc_id", F.md5(B.reencode(c, order, F.lit("littleendian"))).alias("value"))


_SWAPPED = f"""swapped AS (
  SELECT collection, file_name, 11 AS variant_ord, md5(content) AS raw, md5({_SWAP2}) AS hash,
         'Byte Swapped (.v64) — every byte pair swapped' AS label FROM swap_file WHERE substr(hex(content), 1, 4) IN ('8037', '3780', '4012')
  UNION ALL
  SELECT collection, file_name, 12, md5(content), md5({_SWAP4}),
         'Little Endian (.n64) — every 4-byte group reversed' FROM swap_file WHERE substr(hex(content), 1, 4) IN ('8037', '3780', '4012'))"""


@query("byte_order_candidates", f"""WITH {SQL_SWAP}, {_SWAPPED}
SELECT e.collection, e.catalog, s.hash, s.label, e.set_name, e.set_pos, s.n_files, s.first_file,
       1.0::DOUBLE AS confidence, true AS hash_match, 'rename' AS action
FROM (SELECT collection, hash, label, count(*) AS n_files, min(file_name) AS first_file FROM swapped WHERE hash <> raw GROUP BY ALL) s
JOIN swap_entry e ON e.collection = s.collection AND e.hash = s.hash""")
def byte_order_candidates(spark, d):
    return H.swapped_candidates(_swap_variants(spark, d), _swap_entries(spark, d))


@query("byte_order_diagnostics", f"""WITH {SQL_SWAP}, {_SWAPPED},
wanted AS (SELECT DISTINCT collection, catalog, hash FROM swap_entry),
open_file AS (SELECT f.collection, f.collection || '-list' AS catalog, f.file_name, md5(f.content) AS raw, substr(hex(f.content), 1, 4) AS lead
  FROM swap_file f WHERE substr(hex(f.content), 1, 4) IN ('8037', '3780', '4012'))
SELECT collection, catalog, file_name, -1 AS msg_ord, 'N64 format detected: ' || CASE lead WHEN '8037' THEN 'Big Endian (.z64)'
  WHEN '3780' THEN 'Byte Swapped (.v64) — every byte pair swapped' ELSE 'Little Endian (.n64) — every 4-byte group reversed' END AS message FROM open_file
UNION ALL
SELECT o.collection, o.catalog, o.file_name, 0, 'Raw CRC: ' || raw || CASE WHEN w.hash IS NULL THEN ' (not in DAT)' ELSE ' (in DAT)' END
FROM open_file o LEFT JOIN wanted w ON w.collection = o.collection AND w.catalog = o.catalog AND w.hash = o.raw
UNION ALL
SELECT o.collection, o.catalog, o.file_name, s.variant_ord, 'Tried as ' || s.label || ': ' || s.hash || CASE WHEN w.hash IS NULL THEN ' → no match' ELSE ' → MATCH' END
FROM open_file o JOIN swapped s ON s.collection = o.collection AND s.file_name = o.file_name AND s.hash <> s.raw
LEFT JOIN wanted w ON w.collection = o.collection AND w.catalog = o.catalog AND w.hash = s.hash""")
def byte_order_diagnostics(spark, d):
    files = _swap_files(spark, d).select("collection", F.concat("collection", F.lit("-list")).alias("catalog"), "file_name")
    return H.swap_diagnostics(_swap_variants(spark, d), _swap_entries(spark, d), files)


# ---- digest in the header of disc images ----
_IMAGE_VERSION = "CASE lang WHEN 'es' THEN '00000004' ELSE '00000005' END"
SQL_IMAGE = f"image AS (SELECT {fr.DOC_COLLECTION} AS collection, {fr.DOC_NAME} AS file_name, CASE WHEN lang <> 'es' AND 84 + strlen(text) >= 124 THEN sha1(text) END AS embedded_sha1 FROM documents)"


def _images(spark, d):
    content = F.expr(
        "concat(encode('MComprHD', 'UTF-8'), unhex('0000007C'), unhex(" + _IMAGE_VERSION
        + "), unhex(repeat('00', 48)), unhex(sha1(text)), encode(text, 'UTF-8'))")
    return fr.table(spark, d, "documents").select(
        F.expr(fr.DOC_COLLECTION).alias("collection"), F.expr(fr.DOC_NAME).alias("file_name"),
        embedded_sha1(content).alias("embedded_sha1"), F.lit(None).cast("string").alias("hash"))


@query("embedded_digests", f"WITH {SQL_IMAGE} SELECT collection, file_name, embedded_sha1 FROM image")
def embedded_digests(spark, d):
    return _images(spark, d).drop("hash")


@query("embedded_digest_candidates", f"""WITH {SQL_IMAGE}, {fr.SQL_DOC_ENTRY},
listed AS (SELECT collection, catalog, sha1, set_name, min(set_pos) AS set_pos FROM doc_entry GROUP BY ALL)
SELECT e.collection, e.catalog, e.sha1 AS hash, e.set_name, e.set_pos, i.n_files, i.first_file, 1.0::DOUBLE AS confidence,
       true AS hash_match, 'rename' AS action, 'SHA-1 match from CHD header (' || substr(e.sha1, 1, 12) || '…)' AS reason
FROM (SELECT collection, embedded_sha1, count(*) AS n_files, min(file_name) AS first_file FROM image WHERE embedded_sha1 IS NOT NULL GROUP BY ALL) i
JOIN listed e ON e.collection = i.collection AND e.sha1 = i.embedded_sha1""")
def embedded_digest_candidates(spark, d):
    return H.embedded_digest_candidates(_images(spark, d), fr.doc_entries(spark, d))


# ---- reconcile ----
RECON = DOCS + """,
src AS (SELECT collection, hash, min(file_name) AS file_name FROM doc_hash GROUP BY ALL),
entry_result AS (SELECT e.collection, e.catalog, e.set_pos, e.set_name, e.entry_pos, e.entry_name, CAST(1 AS BIGINT) AS n_entries, e.size,
  CASE WHEN s.file_name IS NULL THEN 'missing' ELSE 'ok' END AS status, s.file_name, CAST(NULL AS VARCHAR) AS member_name
  FROM doc_entry e LEFT JOIN src s ON s.collection = e.collection AND s.hash = e.hash),
set_result AS (SELECT collection, catalog, set_pos, min(set_name) AS set_name, count(*) AS expected,
  count(*) FILTER (status = 'ok') AS found, arg_min_null(file_name, entry_pos) AS file_name, CAST(NULL AS VARCHAR) AS member_name,
  min(set_name) || '.zip' AS expected_file_name,
  CASE WHEN count(*) = count(*) FILTER (status = 'ok') THEN 'ok' WHEN count(*) FILTER (status = 'ok') = 0 THEN 'missing' ELSE 'bad_dump' END AS status
  FROM entry_result GROUP BY collection, catalog, set_pos)
"""


def _entry_results(spark, d):
    return R.entry_results(fr.doc_entries(spark, d), fr.doc_hashes(spark, d))


def _set_results(spark, d):
    return R.set_results(_entry_results(spark, d))


query("entry_results", RECON + "SELECT * FROM entry_result")(_entry_results)
query("set_results", RECON + "SELECT * FROM set_result")(_set_results)
query("missing_entries", RECON + "SELECT * FROM entry_result WHERE status = 'missing'")(
    lambda spark, d: R.missing_entries(_entry_results(spark, d)))
query("status_counts", RECON + """SELECT collection, catalog, count(*) FILTER (status = 'ok') AS n_ok,
  count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status NOT IN ('ok', 'missing')) AS n_other
  FROM set_result GROUP BY collection, catalog""")(lambda spark, d: R.status_counts(_set_results(spark, d)))
query("first_sources", RECON + "SELECT collection, hash, file_name, CAST(NULL AS VARCHAR) AS member_name, n_copies FROM "
      "(SELECT collection, hash, min(file_name) AS file_name, count(*) AS n_copies FROM doc_hash GROUP BY ALL)")(
    lambda spark, d: R.first_sources(fr.doc_hashes(spark, d)).select("collection", "hash", "source.*", "n_copies"))

SQL_UNMATCHED = """unmatched AS (SELECT f.collection, f.collection || '-list' AS catalog, f.file_name FROM doc_hash f
  WHERE NOT EXISTS (SELECT 1 FROM doc_entry e WHERE e.collection = f.collection AND e.hash = f.hash))"""
query("unmatched_files", DOCS + f", {SQL_UNMATCHED} SELECT collection, catalog, file_name FROM unmatched")(
    lambda spark, d: R.unmatched_files(fr.doc_hashes(spark, d), fr.doc_entries(spark, d)).select(*SCOPE, "file_name"))


@query("rebuildable_sets", RECON + """SELECT set_name, expected_file_name, expected FROM set_result
WHERE expected = found AND expected_file_name NOT IN (
  SELECT 'set-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || CASE toxic WHEN 1 THEN '.zip' ELSE '.old' END FROM labels)""")
def rebuildable_sets(spark, d):
    there = fr.table(spark, d, "labels").selectExpr(
        "'set-' || lpad(CAST(doc_id AS STRING), 8, '0') || CASE toxic WHEN 1 THEN '.zip' ELSE '.old' END AS expected_file_name")
    return R.rebuildable_sets(_set_results(spark, d), there).select("set_name", "expected_file_name", "expected")


# ---- candidates by content ----
@query("direct_hash_candidates", DOCS + """
SELECT e.collection, e.catalog, e.hash, e.set_name, e.set_pos, c.n_files, c.first_file, 1.0::DOUBLE AS confidence, true AS hash_match,
       'rename' AS action, 'Direct CRC match' AS reason
FROM (SELECT collection, catalog, hash, set_name, min(set_pos) AS set_pos FROM doc_entry GROUP BY ALL) e
JOIN (SELECT collection, hash, count(*) AS n_files, min(file_name) AS first_file FROM doc_hash GROUP BY ALL) c
  ON c.collection = e.collection AND c.hash = e.hash""")
def direct_hash_candidates(spark, d):
    return H.direct_candidates(_variants(spark, d), fr.doc_entries(spark, d))


@query("stripped_hash_candidates", DOCS + """
SELECT e.collection, e.catalog, e.hash, c.prefix, c.label, e.set_name, e.set_pos, c.n_files, c.first_file, 0.95::DOUBLE AS confidence,
       true AS hash_match, 'rename' AS action
FROM (SELECT collection, catalog, hash, set_name, min(set_pos) AS set_pos FROM doc_entry GROUP BY ALL) e
JOIN (SELECT collection, hash, prefix, label, count(*) AS n_files, min(file_name) AS first_file FROM doc_variant GROUP BY ALL) c
  ON c.collection = e.collection AND c.hash = e.hash""")
def stripped_hash_candidates(spark, d):
    return H.stripped_candidates(_variants(spark, d), fr.doc_entries(spark, d))


@query("stripped_size_candidates", DOCS + """,
miss AS (SELECT v.* FROM doc_variant v WHERE NOT EXISTS (SELECT 1 FROM doc_entry e WHERE e.collection = v.collection AND e.hash = v.hash)),
first_entry AS (SELECT collection, catalog, set_pos, arg_min(hash, entry_pos) AS expected_hash FROM doc_entry GROUP BY ALL)
SELECT s.collection, s.catalog, s.size, c.prefix, s.set_name, s.set_pos, c.n_files, c.first_file, f.expected_hash, 0.3::DOUBLE AS confidence,
       false AS hash_match, 'crc_mismatch' AS action
FROM (SELECT collection, catalog, size, set_name, min(set_pos) AS set_pos FROM doc_entry WHERE size > 0 GROUP BY ALL) s
JOIN (SELECT collection, size, prefix, count(*) AS n_files, min(file_name) AS first_file FROM miss GROUP BY ALL) c
  ON c.collection = s.collection AND c.size = s.size
JOIN first_entry f ON f.collection = s.collection AND f.catalog = s.catalog AND f.set_pos = s.set_pos""")
def stripped_size_candidates(spark, d):
    return H.size_candidates(_variants(spark, d), fr.doc_entries(spark, d))
