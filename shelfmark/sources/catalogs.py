"""Catalogue sources: XML files of expected sets, plain or zipped.

All columns have an explicit schema: inferred types would turn the hash 00000012 into a number.
"""

from __future__ import annotations

import io
import xml.parsers.expat
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.session import ship

ENTRY = "_name string, _size string, _crc string, _md5 string, _sha1 string"
SET = f"_name string, description string, rom array<struct<{ENTRY.replace(' string', ':string')}>>, _rejected string"
HEADER = "name string, description string, version string, author string"
OUT = (
    "catalog_path string, set_pos bigint, set_name string, description string, entry_pos int, "
    "entry_name string, size bigint, crc string, md5 string, sha1 string"
)


def _source_path(meta: str = "_metadata.file_path") -> Column:
    # metadata paths are percent-encoded
    return F.url_decode(F.replace(F.col(meta), F.lit("+"), F.lit("%2B")))


def read_sets(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """One row per <game> of the plain catalogues under ``path``."""
    return (
        spark.read.format("xml").option("rowTag", "game").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_rejected").option("pathGlobFilter", pattern)
        .option("ignoreSurroundingSpaces", True).schema(SET).load(path)
        .withColumns({"catalog_path": _source_path(), "set_pos": F.monotonically_increasing_id()})
    )


def _key(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def broken_catalogs(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """(catalog_path, error) of plain catalogues that are not whole, well-formed documents."""
    ship(spark)

    def parsed(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                parser = xml.parsers.expat.ParserCreate()
                try:
                    parser.Parse(row.content, True)
                except Exception as exc:  # reported; the others go on
                    rows.append((row.path, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["catalog_path", "error"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return raw.mapInPandas(parsed, "catalog_path string, error string")


def read_entries(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """One row per <rom>, and one with NULL entry columns per set without any.

    A catalogue that is broken anywhere gives no rows: half a catalogue would report sets as unknown.
    Positions follow the document. Write the result as a table before using it in several joins.
    """
    broken = broken_catalogs(spark, path, pattern).select(_key(F.col("catalog_path")).alias("_broken"))
    sets = read_sets(spark, path, pattern)
    sets = sets.join(broken, _key(F.col("catalog_path")) == F.col("_broken"), "left_anti").filter(F.col("_rejected").isNull())
    rows = sets.select(
        "catalog_path", "set_pos", F.coalesce("_name", F.lit("")).alias("set_name"),
        N.strip(F.coalesce("description", F.lit(""))).alias("description"), F.posexplode_outer("rom").alias("entry_pos", "r"))
    return rows.select(
        "catalog_path", "set_pos", "set_name", "description", "entry_pos",
        F.when(F.col("r").isNotNull(), F.coalesce("r._name", F.lit(""))).alias("entry_name"),
        F.when(F.col("r").isNotNull(), F.coalesce(F.expr("try_cast(r._size as bigint)"), F.lit(0))).alias("size"),
        F.lower("r._crc").alias("crc"), F.lower("r._md5").alias("md5"), F.lower("r._sha1").alias("sha1"),
    )


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per plain catalogue; the file stem stands in for a missing header or name."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").load(path).select(F.col("path").alias("catalog_path"))
    )
    heads = (
        spark.read.format("xml").option("rowTag", "header").option("pathGlobFilter", "*.dat")
        .option("mode", "PERMISSIVE").schema(HEADER).load(path).withColumn("catalog_path", _source_path())
    )
    joined = files.withColumn("_k", _key(F.col("catalog_path"))).join(
        heads.withColumn("_k", _key(F.col("catalog_path"))).drop("catalog_path"), "_k", "left")
    return _named(joined)


def _named(heads: DataFrame) -> DataFrame:
    name = N.strip(F.coalesce("name", F.lit("")))
    stem = N.stem(F.col("catalog_path"))
    return heads.select(
        "catalog_path", F.when(name == "", stem).otherwise(name).alias("name"),
        *[N.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("description", "version", "author")],
        F.when(name == "", stem).otherwise(N.clean_collection_name(name)).alias("collection"),
    )


def _zipped_xml(content: bytes):
    """The catalogue inside an archive: its first .dat member, else its first .xml member."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    listed = archive.namelist()
    for ending in (".dat", ".xml"):
        for name in listed:
            if name.lower().endswith(ending):
                return archive.open(name)
    raise ValueError("no .dat or .xml member")


def _size(text: str | None) -> int:
    """As the plain reader takes it: 0 unless it is a whole number."""
    text = (text or "").strip()
    return int(text) if text.lstrip("+-").isdecimal() else 0


def _zipped_rows(path: str, content: bytes):
    pos = 0
    for _, node in ET.iterparse(_zipped_xml(content), events=("end",)):
        if node.tag != "game":
            continue
        name, text = node.get("name", ""), (node.findtext("description") or "").strip()
        entries = list(node.iter("rom"))
        if not entries:
            yield path, pos, name, text, None, None, None, None, None, None
        for k, e in enumerate(entries):
            digests = [(e.get(a) or "").lower() or None for a in ("crc", "md5", "sha1")]
            yield path, pos, name, text, k, e.get("name", ""), _size(e.get("size")), *digests
        pos += 1
        node.clear()


def read_zipped_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of zipped catalogues, in the shape of ``read_entries`` plus ``error`` for unreadable ones."""
    ship(spark)

    def run(batches):
        names = [part.split()[0] for part in OUT.split(", ")]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                # rows are held until the whole catalogue is read: a broken one gives its error alone
                try:
                    rows = [(*one, None) for one in _zipped_rows(row.path, row.content)]
                except Exception as exc:  # an unreadable catalogue is reported, the others go on
                    rows = [(row.path, *[None] * 9, f"{type(exc).__name__}: {exc}")]
                for at in range(0, len(rows), 10_000):
                    yield frame(rows[at:at + 10_000], names)

    def frame(rows, names):
        return pd.DataFrame(rows, columns=[*names, "error"]).astype(
            {"set_pos": "Int64", "entry_pos": "Int32", "size": "Int64"})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return raw.mapInPandas(run, OUT + ", error string")


def read_zipped_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of zipped catalogues, in the shape of ``read_headers``; unreadable ones are left out."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                try:
                    head = next((n for _, n in ET.iterparse(_zipped_xml(row.content), events=("end",)) if n.tag == "header"), None)
                except Exception:  # listed by rejected_catalogs
                    continue
                texts = [head.findtext(tag) if head is not None else None for tag in ("name", "description", "version", "author")]
                rows.append((row.path, *texts))
            yield pd.DataFrame(rows, columns=["catalog_path", "name", "description", "version", "author"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return _named(raw.mapInPandas(run, "catalog_path string, " + HEADER))


def discover_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """Plain catalogues, then zipped ones, each by name: ``catalog_group`` and ``catalog_path`` give the order."""
    plain = read_headers(spark, path).withColumn("catalog_group", F.lit(0))
    return plain.unionByName(read_zipped_headers(spark, path).withColumn("catalog_group", F.lit(1)))


def rejected_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """Catalogues that could not be read as a whole: (catalog_path, error)."""
    zipped = read_zipped_entries(spark, path).filter(F.col("error").isNotNull()).select("catalog_path", "error")
    return broken_catalogs(spark, path).unionByName(zipped)
