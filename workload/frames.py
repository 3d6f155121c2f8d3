"""Our tables, derived from the driver's: once as DataFrames, once as SQL common table expressions.

Both sides share the text of each derived column wherever the two dialects agree. Every frame
covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark import session

FILLER = "0000000000000000"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table. Its schema is looked up once, not once per use."""
    session.tune(spark)
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _pick(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {whens} ELSE '{values[-1]}' END"


# ---- documents: entries with two members per set, and files whose content is held in four ways ----
SET_ID = "CAST(floor(doc_id / 2) AS BIGINT)"
DOC_COLLECTION = f"'c' || CAST({SET_ID} % 4 AS STRING)"
DOC_NAME = "'doc-' || lpad(CAST(doc_id AS STRING), 8, '0') || '.txt'"
DOC_ENTRY = {
    "collection": DOC_COLLECTION,
    "catalog": f"{DOC_COLLECTION} || '-list'",
    "set_pos": SET_ID,
    "set_name": f"'set-' || lpad(CAST({SET_ID} AS STRING), 8, '0')",
    "entry_pos": "CAST(doc_id % 2 AS INT)",
    "entry_name": DOC_NAME,
    "hash": "md5(text)",
    "sha1": "sha1(text)",
}
# held as listed, behind a prefix, behind a prefix and altered, with something appended
DOC_HELD = (
    f"CASE lang WHEN 'en' THEN text WHEN 'de' THEN '{FILLER}' || text "
    f"WHEN 'fr' THEN '{FILLER}' || replace(text, 'e', 'a') ELSE text || 'x' END"
)


def _columns(cols: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in cols.items()]


def doc_entries(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr(*_columns(DOC_ENTRY), "CAST(octet_length(text) AS BIGINT) AS size")


def doc_files(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        f"{DOC_COLLECTION} AS collection", f"{DOC_NAME} AS file_name", f"encode({DOC_HELD}, 'UTF-8') AS content")


def doc_hashes(spark, d) -> DataFrame:
    return doc_files(spark, d).select(
        "collection", "file_name", F.lit(None).cast("string").alias("member_name"), F.md5("content").alias("hash"))


SQL_DOC_ENTRY = f"doc_entry AS (SELECT {', '.join(_columns(DOC_ENTRY))}, CAST(strlen(text) AS BIGINT) AS size FROM documents)"
SQL_DOC_FILE = (
    f"doc_file AS (SELECT {DOC_COLLECTION} AS collection, {DOC_NAME} AS file_name, encode({DOC_HELD}) AS content FROM documents)"
)
SQL_DOC_HASH = "doc_hash AS (SELECT collection, file_name, md5(content) AS hash FROM doc_file)"
SQL_DOC_VARIANT = """doc_variant AS (
  SELECT f.collection, f.file_name, 'prefix' AS kind, p.prefix, p.label, p.ord AS variant_ord,
         md5(array_slice(content, p.prefix + 1, octet_length(content))) AS hash,
         CAST(octet_length(content) - p.prefix AS BIGINT) AS size, content
  FROM doc_file f JOIN (VALUES (1, 512, 'SMC/SWC copier header (SNES)'), (2, 16, 'iNES header (NES)'),
                               (3, 64, 'Lynx header'), (4, 8192, 'Atari 7800 header')) p(ord, prefix, label)
    ON octet_length(content) > p.prefix)"""
DOCS = f"WITH {SQL_DOC_ENTRY}, {SQL_DOC_FILE}, {SQL_DOC_HASH}, {SQL_DOC_VARIANT}"


# ---- part: sets with regional names, files named after them in six ways ----
REGION = _pick("p_size % 5", ["USA", "Japan", "Europe", "World", "France"])
CODE = _pick("p_size % 5", ["U", "J", "E", "W", "F"])
# names grow with the data: two neighbouring parts share a number, and the odd one's file carries a tag, so no file name is there twice
KEY = "CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)"
TAG = "CASE WHEN p_partkey % 2 = 1 THEN ' [' || CAST(p_partkey AS STRING) || ']' ELSE '' END"
TITLE = f"upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || {KEY} || ' ' || p_brand"
SET_NAME = f"{TITLE} || ' (' || {REGION} || ')'"
CATALOG = "lower(p_type) || CASE WHEN p_size > 25 THEN '-a' ELSE '-b' END"
ENTRY_EXT = _pick("p_size % 4", [".sfc", ".nes", ".iso", ".bin"])
FILE_EXT = _pick("p_size % 3", [".zip", ".sfc", ".bin"])
STEM = f"""CASE p_size % 6 WHEN 0 THEN lower({SET_NAME}) WHEN 1 THEN {TITLE} || ' (' || {CODE} || ')'
  WHEN 2 THEN {TITLE} || ' (J) [!]' WHEN 3 THEN p_name || ' ' || {KEY}
  WHEN 4 THEN 'Super ' || p_name || ' ' || {KEY} || ' ' || p_brand || ' Challenge (U)'
  ELSE replace(p_name, ' ', '') || {KEY} || replace(p_brand, '#', '') END || {TAG}"""
PART_SET = {
    "collection": "p_type", "catalog": CATALOG, "set_pos": "p_partkey", "set_name": SET_NAME,
    "entry_pos": "CAST(0 AS INT)", "entry_name": f"{SET_NAME} || {ENTRY_EXT}",
    "size": "CAST(p_size * 1024 AS BIGINT)", "hash": f"md5({SET_NAME})",
}
PART_FILE = {
    "collection": "p_type", "file_name": f"{STEM} || {FILE_EXT}", "file_pos": "p_partkey",
    # what the content hashes to, whole and behind a 512-byte prefix
    "raw_hash": f"CASE WHEN p_size % 6 = 0 THEN md5({SET_NAME}) ELSE md5({STEM}) END",
    "cut_hash": f"CASE WHEN p_size % 6 = 1 THEN md5({SET_NAME}) ELSE md5('cut' || {STEM}) END",
    "cut_size": "CAST((p_size + CASE WHEN p_size % 6 IN (3, 5) THEN 100 ELSE 0 END) * 1024 AS BIGINT)",
}


def part_sets(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr(*_columns(PART_SET))


def part_files(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr(*_columns(PART_FILE))


def part_variants(spark, d) -> DataFrame:
    return part_files(spark, d).selectExpr(
        "collection", "file_name",
        """explode(array(
             struct('raw' AS kind, CAST(NULL AS INT) AS prefix, CAST(NULL AS STRING) AS label, raw_hash AS hash,
                    cut_size + 512 AS size, CAST(NULL AS INT) AS zero_pct, 0 AS variant_ord),
             struct('prefix' AS kind, 512 AS prefix, 'SMC/SWC copier header (SNES)' AS label, cut_hash AS hash,
                    cut_size AS size, 100 AS zero_pct, 1 AS variant_ord))) AS v""",
    ).select("collection", "file_name", "v.*")


SQL_PART_SET = f"part_set AS (SELECT {', '.join(_columns(PART_SET))} FROM part)"
SQL_PART_FILE = f"part_file AS (SELECT {', '.join(_columns(PART_FILE))} FROM part)"
SQL_PART_STEM = r"part_stem AS (SELECT DISTINCT collection, regexp_replace(file_name, '\.[^.]+$', '') AS stem FROM part_file)"
SQL_PART_VARIANT = """part_variant AS (
  SELECT collection, file_name, 'raw' AS kind, CAST(NULL AS INT) AS prefix, CAST(NULL AS STRING) AS label, raw_hash AS hash,
         cut_size + 512 AS size, 0 AS variant_ord FROM part_file
  UNION ALL
  SELECT collection, file_name, 'prefix', 512, 'SMC/SWC copier header (SNES)', cut_hash, cut_size, 1 FROM part_file)"""
PARTS = f"WITH {SQL_PART_SET}, {SQL_PART_FILE}, {SQL_PART_STEM}, {SQL_PART_VARIANT}"


# ---- part as settled result rows ----
RESULT = {
    "collection": "p_type", "row_pos": "p_partkey", "set_name": SET_NAME,
    "description": SET_NAME,
    "file_name": f"CASE WHEN p_size % 8 = 4 THEN NULL ELSE {STEM} || '-' || CAST(p_partkey AS STRING) || {FILE_EXT} END",
    "expected_file_name": f"{SET_NAME} || '.zip'",
    "status": _pick("p_size % 8", ["matched", "matched", "unverified", "unmatched", "missing", "ok", "bad_dump", "duplicate"]),
    "note": "CASE WHEN p_size % 8 = 3 THEN 'No similar DAT entry found' ELSE '' END",
    "plan": "CASE WHEN p_size % 8 IN (0, 1) THEN CASE WHEN p_size % 3 = 0 THEN 'ok' ELSE 'modify' END WHEN p_size = 50 THEN 'exclude' ELSE '' END",
}


def results(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr(*_columns(RESULT))


RESULTS = f"WITH result AS (SELECT {', '.join(_columns(RESULT))} FROM part)"


# ---- conversations: archives with one member per turn ----
CONV_COLLECTION = _pick("conv_id % 3", ["Nintendo - Super Nintendo", "Sony - PlayStation 2", "Homebrew"])
MEMBER = {
    "collection": CONV_COLLECTION,
    "file_name": "'conv-' || CAST(conv_id AS STRING) || '.zip'",
    "member_pos": "CAST(turn AS INT)",
    "member_name": "role || '-' || CAST(turn AS STRING) || CASE role WHEN 'assistant' THEN '.sfc' WHEN 'user' THEN '.bin' ELSE '.txt' END",
    "crc": "md5(text)",
}


def members(spark, d) -> DataFrame:
    return table(spark, d, "conversations").selectExpr(*_columns(MEMBER), "CAST(octet_length(text) AS BIGINT) AS size")


MEMBERS = f"""WITH member AS (SELECT {', '.join(_columns(MEMBER))}, CAST(strlen(text) AS BIGINT) AS size FROM conversations),
typed AS (SELECT *, lower(regexp_extract(member_name, '[^/](\\.[^./]+)$', 1)) AS ext,
  CASE collection WHEN 'Nintendo - Super Nintendo' THEN ['.sfc', '.smc', '.swc', '.fig']
       WHEN 'Sony - PlayStation 2' THEN ['.bin', '.iso', '.img', '.chd', '.cue'] END AS accepted FROM member)"""


# ---- supplier and customer: catalogue and directory names, after the documented pairs ----
# Catalogue name, directory name
PAIRS = [
    ("Nintendo - Nintendo Entertainment System", "Nintendo - NES"),
    ("Nintendo - Super Nintendo Entertainment System", "Nintendo - SNES"),
    ("Nintendo - Nintendo 64", "Nintendo - N64"),
    ("Nintendo - Game Boy", "Nintendo - GB"),
    ("Nintendo - Game Boy Advance", "Nintendo - GBA"),
    ("Nintendo - Game Boy Color", "Nintendo - GBC"),
    ("Nintendo - Nintendo DS", "Nintendo - DS"),
    ("Nintendo - Nintendo 3DS", "Nintendo - 3DS"),
    ("Sega - Mega Drive - Genesis", "Sega - Genesis"),
    ("Sega - Game Gear", "Sega - Game Gear"),
    ("Sega - Master System", "Sega - SMS"),
    ("Sony - PlayStation", "Sony - PS1"),
    ("Sony - PlayStation 2", "Sony - PS2"),
    ("Sony - PlayStation Portable", "Sony - PSP"),
    ("NEC - PC Engine - TurboGrafx-16", "NEC - PC Engine"),
    ("Atari - Atari 2600", "Atari - 2600"),
    ("Commodore - Commodore 64", "Commodore - 64"),
    ("SNK - NeoGeo Pocket", "SNK - Neo Geo Pocket"),
]
_CAT, _DIR = _pick("s_suppkey % 18", [a for a, _ in PAIRS]), _pick("c_custkey % 18", [b for _, b in PAIRS])
CATALOG_ROW = {
    "catalog_path": "'/catalogs/' || CAST(s_suppkey AS STRING) || '.dat'",
    "catalog_name": f"CASE s_nationkey % 4 WHEN 0 THEN 'Redump - ' || {_CAT} WHEN 1 THEN {_CAT} || ' (20240101-000000)' "
                    f"WHEN 2 THEN 'Non-Redump - ' || {_CAT} ELSE {_CAT} END",
    "pos": "s_suppkey",
}
DIRECTORY_ROW = {
    "path": "'/files/' || CAST(c_custkey AS STRING)",
    "collection": f"CASE c_nationkey % 5 WHEN 0 THEN 'TOSEC - ' || {_DIR} WHEN 1 THEN {_DIR} || ' (old)' ELSE {_DIR} END",
    "pos": "c_custkey",
}


def catalogs(spark, d) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(*_columns(CATALOG_ROW))


def directories(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr(*_columns(DIRECTORY_ROW))


COLLECTIONS = (
    f"WITH catalog_row AS (SELECT {', '.join(_columns(CATALOG_ROW))} FROM supplier), "
    f"directory_row AS (SELECT {', '.join(_columns(DIRECTORY_ROW))} FROM customer)"
)
