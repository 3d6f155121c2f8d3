"""Exact dedup: texts that are equal up to runs of white space keep the row with the smallest id.

Rows are grouped by a 128-bit digest and, inside a digest, by the text itself, so texts whose digests collide are
told apart by their bytes. Both grouping columns take part in Spark's partial aggregation: however many rows share a
text, each task sends it on once.

Cases: a null text counts as the empty one; empty texts are a group like any other; rows that repeat an id stay rows
of their own; a null id is never smaller than another id, and keep_id is null only if all ids of the group are;
of several rows with the smallest id ``groups`` marks all, ``deduplicate`` keeps one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, narrow
from .registry import query


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = narrow(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    keyed = rows.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    texts = keyed.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # members find their text again by both digests; should two texts share even both, stop instead of merging them
    named = texts.select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    kept = named.groupBy("digest", "text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts"))
    same = F.when(F.col("n_texts") > 1, F.raise_error(F.lit("two texts share both digests"))).otherwise(F.col("keep_id"))
    members = keyed.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"))
    return members.join(kept.withColumn("keep_id", same.cast("long")), ["digest", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with all its columns: the smallest id, then the smallest unnormalised text.

    The row itself is what is aggregated, so a repeated or missing id decides nothing about rows of other texts. Rows meet
    by the digest and, behind it, by the text itself: bytes decide what is equal.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    keyed = docs.select(F.struct("*").alias("row"), first.alias("first"), normalised(text).alias("text"))
    keyed = keyed.select("row", "first", F.md5("text").alias("digest"), "text")
    return keyed.groupBy("digest", "text").agg(F.min_by("row", "first").alias("row")).select("row.*")


@query("op8_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)""")
def op8(spark, sf_dir):
    return groups(documents(spark, sf_dir))
