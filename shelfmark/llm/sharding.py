"""Sharding by extendible hashing: a directory over hash prefixes in which only buckets beyond the byte limit split.

Every document has a 60-bit hash of its id. Buckets are prefixes of it; a bucket whose documents exceed the limit is
split on one more bit, the others are left alone. Only (id, hash, size) rows take part in that, and after the first
round only those of buckets that are still too large. Texts move once, to the shard they are written to.

Cases: a null text has 0 bytes; a null id is hashed by its text. A bucket that no bit can split (one document, or
rows that repeat one id) stays whole beyond the limit and is marked ``oversized``. An empty table gives no shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut, scratch

from .common import documents, narrow
from .registry import query

BITS = 60
#: bytes of text a shard may hold
LIMIT = 64 << 20


def hashed(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), text))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("hash"), BITS - bits)


def directory(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Buckets as (depth, prefix, shard, shard_docs, shard_bytes, oversized), and the depth at which the directory starts.

    No directory of fewer entries than total / limit can hold all, so the splitting starts at that depth.
    """
    rows = cut(narrow(docs, id_col, text_col).select(hashed(F.col("doc_id"), F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    start = depth = min(BITS, max(0, int(math.log2(max(total, 1) / limit))))
    spark, done = docs.sparkSession, []
    while True:
        sums = cut(rows.groupBy(prefix(depth).alias("prefix")).agg(
            F.count(F.lit(1)).alias("shard_docs"), F.sum("n_bytes").alias("shard_bytes"), (F.min("hash") == F.max("hash")).alias("single")))
        too_large = (F.col("shard_bytes") > limit) & ~F.col("single")
        done.append(sums.where(~too_large).select(
            F.lit(depth).alias("depth"), "prefix",
            F.concat(F.lit("b"), F.lpad(F.bin("prefix"), depth, "0") if depth else F.lit("")).alias("shard"),
            "shard_docs", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized")))
        split = sums.where(too_large).select(F.col("prefix").alias("_p"))
        if split.isEmpty():
            break
        rows = cut(rows.join(split, prefix(depth) == F.col("_p"), "left_semi"))
        depth += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, start


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all columns of ``docs`` (in a struct ``row``) as Parquet, one folder a shard, and return the directory.

    Rows meet their bucket on the prefix all buckets share, which leaves every shard in one partition: texts shuffle once.
    """
    buckets, start = directory(docs, limit, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), hashed(F.col(id_col), text).alias("hash"))
    fits = F.expr(f"shiftrightunsigned(hash, {BITS} - depth) = prefix")
    found = buckets.select("depth", "prefix", "shard", F.expr(f"shiftrightunsigned(prefix, depth - {start})").alias("top"))
    rows.withColumn("top", prefix(start)).join(found.hint("shuffle_hash"), ["top"]).where(fits).select("shard", "row").write.partitionBy("shard").parquet(path)
    return buckets


_SQL = """
WITH docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
start AS (SELECT greatest(0, floor(log2(greatest(sum(n_bytes), 1) / {limit})))::BIGINT AS s FROM docs),
levels AS (SELECT doc_id, n_bytes, s + d AS depth, h >> (60 - (s + d)) AS prefix, h FROM docs, start, range(0, 24) r(d)),
sums AS (SELECT depth, prefix, count(*) AS shard_docs, sum(n_bytes) AS shard_bytes, min(h) = max(h) AS single FROM levels GROUP BY depth, prefix),
fit AS (SELECT doc_id, min(l.depth) AS depth FROM levels l JOIN sums USING (depth, prefix) WHERE shard_bytes <= {limit} OR single GROUP BY doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, depth::INT AS depth,
       shard_docs, shard_bytes::BIGINT AS shard_bytes, shard_bytes > {limit} AS oversized
FROM fit JOIN levels USING (doc_id, depth) JOIN sums USING (depth, prefix)"""


def shards(spark, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of shards that are written and read back, each with its shard's directory entry."""
    path = scratch(spark, "shards")
    buckets = write_shards(docs, path, limit)
    back = spark.read.parquet(path).select("shard", F.col("row.doc_id"), F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_bytes"))
    return back.join(buckets.drop("prefix"), "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", "oversized")


@query("op6_sharding", _SQL.format(limit=LIMIT))
def op6(spark, sf_dir):
    return shards(spark, documents(spark, sf_dir))


@query("sharding_depths", _SQL.format(limit="(SELECT greatest(1, sum(n_bytes) // 16) FROM docs)"))
def depths(spark, sf_dir):
    """Shards of a sixteenth of the table at most, so that buckets split to several depths at every size."""
    docs = documents(spark, sf_dir)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return shards(spark, docs, max(1, total // 16))
