"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch holds the k smallest distinct 48-bit hashes of a text's shingles. The sketch of a union is the bottom k of
the sketches' union, so parts are sketched apart and merged; two sketches estimate resemblance and containment, and
one sketch the number of distinct shingles. Everything is array expressions in the JVM.

Cases: words are split by ASCII white space; a text with fewer words than a shingle has one shingle, all its words;
an empty, blank or null text has the empty sketch, which resembles only another empty one (1, else 0). With repeated
ids, the next document is the smallest larger id and, among its rows, the smallest text; a row without an id has no
next document: the text is kept, near_next is null and the end is replaced by nothing. A single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, documents, in_order, narrow
from .registry import query

K = 128
SHINGLE = 5
HASH_BITS = 48


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` and the sketch of column ``text`` as an ascending array of longs."""
    words = F.transform(F.filter(F.split(F.col(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, words.alias("_words"))
    n = F.size("_words")
    # the lambda reads one prepared array, by position: no slices are made
    runs = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(shingle)]))
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64(F.col("_words")))).otherwise(runs)
    df = df.select(*keep, hashes.alias("_hashes"))
    low = F.transform("_hashes", lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS))
    return df.select(*keep, bottom(low, k).alias(out))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def merge_rows(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch a group of rows. Each task passes on at most k hashes of a group."""
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_one"))
    low = hashes.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("_h"))).where(F.col("_rank") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom k that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << HASH_BITS)) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds too."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def followers(rows: DataFrame) -> DataFrame:
    """(doc_id, next_id) over all distinct ids, after the last the first; no partition sees more than its own range."""
    ids = in_order(rows.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id")
    # one row a slice: the first id of each slice follows the last id of the slice before
    firsts = ids.groupBy("slice").agg(F.min("doc_id").alias("first"))
    start = ids.agg(F.min("doc_id").alias("start"))
    after = firsts.withColumn("after", F.lead("first").over(W.orderBy("slice"))).select("slice", "after")
    own = ids.withColumn("own", F.lead("doc_id").over(W.partitionBy("slice").orderBy("at")))
    return own.join(F.broadcast(after), "slice").join(F.broadcast(start)).select("doc_id", F.coalesce("own", "after", "start").alias("next_id"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document."""
    # a key that is never null: both joins below then deal out the very same rows by it, and texts shuffle once
    no_id = -(1 << 63)
    rows = narrow(docs, id_col, text_col)
    sizes = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    # what a document's predecessor needs of it: as many leading characters as the predecessor gives up
    wanted = followers(rows).join(sizes, "doc_id").select(
        F.col("next_id").alias("key"), F.col("doc_id").alias("for"), F.floor(F.col("n") / 2).cast("int").alias("n_taken"))
    # sketches are made behind the shuffle, which moves texts alone
    rows = rows.select(F.coalesce("doc_id", F.lit(no_id)).alias("key"), "text")
    given = with_sketch(rows.join(wanted.hint("shuffle_hash"), "key"), "text", "next_sketch", k, shingle)
    given = given.groupBy(F.col("for").alias("key")).agg(
        F.min(F.struct(F.expr("substring(text, 1, n_taken)").alias("head"), "next_sketch")).alias("next"))
    own = with_sketch(rows.join(given, "key", "left"), "text", "sketch", k, shingle)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    own = own.withColumn("n_chars", F.char_length("text").cast("long")).select(
        "key", "n_chars", "sketch", "next.next_sketch",
        F.concat(kept, F.coalesce(F.substring(F.col("next.head"), F.lit(1), half), F.lit(""))).alias("edited"))
    both = with_sketch(own, "edited", "edited_sketch", k, shingle)
    return both.select(
        F.when(F.col("key") != no_id, F.col("key")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        F.when(F.col("next_sketch").isNotNull(), resemblance(F.col("sketch"), F.col("next_sketch"), k)).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"), containment(F.col("sketch"), F.col("edited_sketch"), k).alias("held_by_edited"))


@query("op4_fingerprints")
def op4(spark, sf_dir):
    return compare_edited(documents(spark, sf_dir))
