"""A corpus from documents to packed sequences: what is toxic goes, then copies, then near copies; the rest is mixed and packed.

Cases, for every stage: a row without text is never toxic, equals an empty text, is near to nothing, and has one token,
its end id; a row without an id is judged by its own text and stays behind rows with one; rows that repeat an id are told
apart by their texts, whole repeated rows are copies; ties go to the smallest id; very long texts are read whole; further
columns, however named, go along until packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from shelfmark.session import scratch


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the fitted model doesn't call toxic, row by row; documents without text stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the one with the smallest id."""
    return exact_dedup.deduplicate(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles, the smallest id."""
    return near_dedup.deduplicate(docs, shingle=5, share=(80, 100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, interleaved by source: the files of the result, in order, hold the mixture."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, numbered in the order of the files and their rows.

    ``docs`` is a table read from files; files are in the order of the part and chunk numbers in their names, others by a
    digest of the name.
    """
    file = docs.metadataColumn("_metadata")
    name = file["file_name"]
    part, more = (F.coalesce(F.regexp_extract(name, x, 1).try_cast("long"), F.lit(0)) for x in (r"part-(\d+)", r"-c(\d+)\."))
    placed = docs.select("doc_id", "text", part.alias("part"), more.alias("more"), F.xxhash64(name).alias("file"), file["row_index"].alias("row"))
    return packing.pack(placed, order=("part", "more", "file", "row"))


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", no_copies),
    ("near dedup", no_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: the fitted model and the token ids are beyond SQL: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
