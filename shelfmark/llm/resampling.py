"""Importance resampling towards a target distribution: documents drawn by how much their features resemble a target's.

Features are all runs of up to ``n`` words, joined by one space; each falls into a bucket by its CRC-32. The features of
a block of documents are grouped by their length into matrices of bytes, one a length, in which all checksums are
updated column by column (``functions/checksums.py``), and the buckets go back to where the features came from. One
pass counts the buckets of the corpus and of the target, a second sums every document's gains; the counts are a number a
bucket, whatever the data, so they alone pass through the driver.

Each document's weight plus Gumbel noise from a digest of its id is its score: the highest scores are a draw without
replacement in proportion to exp(weight / 1000). Ranks are places in a range-partitioned order.

Cases: a null or empty text, or one without words, has no feature and weight 0; it is never drawn. A row without an id
takes the noise of an empty id and stands behind others of its score. Rows that repeat an id share their noise and are
each drawn or not; of equal scores the smaller id, then fewer features come first. Very long words are whole features.
An empty corpus gives an empty result, an empty target gains from its smoothing alone. Further columns stay out of the
way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import checksums

from .common import documents, in_order, narrow, ship
from .registry import query

BUCKETS = 10_000
WORDS = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: bytes of text looked at together, whole documents at least
BLOCK = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[ord("0"):ord("9") + 1] = _INSIDE[ord("a"):ord("z") + 1] = _INSIDE[0x80:] = True


def blocks(texts: pa.Array):
    """Runs of documents as (first, last, bytes of all, where each begins and the last ends)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, length and document of every word in them."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.append(inside[1:], False) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return data, starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every feature, and the number of words of every document."""
    data, starts, lengths, doc = words(data, offsets)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    if n == 1:
        return checksums.crc32s(data, starts, lengths) % np.uint32(buckets), doc, counts
    # the words one after the other, each with a space behind it: a run of words is a stretch
    at = np.append(0, np.cumsum(lengths + 1))
    text = np.full(int(at[-1]), ord(" "), np.uint8)
    place = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)
    text[place] = data[place + np.repeat(starts - at[:-1], lengths)]
    found, docs = [], []
    for k in range(1, n + 1):
        first = np.flatnonzero(doc[:len(doc) - k + 1] == doc[k - 1:])
        found.append(checksums.crc32s(text, at[first], at[first + k] - 1 - at[first]) % np.uint32(buckets))
        docs.append(doc[first])
    return np.concatenate(found), np.concatenate(docs), counts


def histogram(docs: DataFrame, n: int, buckets: int, id_col: str, text_col: str) -> np.ndarray:
    """How many features of the whole table lie in each bucket."""
    ship(docs.sparkSession)

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                total += np.bincount(features(data, offsets, n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = narrow(docs, id_col, text_col).select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    # a row a bucket at most
    held = rows.toArrow()
    out[held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the smoothed log ratio of its shares, rounded down."""
    buckets = len(target)
    more, fewer = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * more / ((s + 1) * fewer))) for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    ship(docs.sparkSession)
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def summed(batches):
        gain = shared.value
        for batch in batches:
            for at, to, data, offsets in blocks(batch.column(1)):
                bucket, doc, counts = features(data, offsets, n, buckets)
                # whole numbers far below 2**53: sums of doubles are exact
                weight = np.bincount(doc, gain[bucket].astype(float), minlength=to - at).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(counts), pa.array(np.bincount(doc, minlength=to - at)), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return narrow(docs, id_col, text_col).mapInArrow(summed, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, n: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_features, weight, score, rank (null: not drawn), n_words."""
    spark = docs.sparkSession
    gain = gains(histogram(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), n, buckets, "id", "text"), histogram(docs, n, buckets, id_col, text_col))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed(docs, gain, n, id_col, text_col).withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least_words)
    laid = in_order(scored, F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    # a row a slice of the order
    sizes = sorted((r["slice"], r["n"], r["able"]) for r in laid.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if("able").alias("able")).collect())
    drawn, seen, starts = sum(x[2] for x in sizes) * percent // 100, 0, []
    for part, count, _ in sizes:
        starts.append((part, seen))
        seen += count
    place = F.col("at") + F.col("start") + 1
    ranked = laid.join(F.broadcast(spark.createDataFrame(starts, "slice long, start long")), "slice")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"), "n_words")


@query("op13_resampling", r"""
WITH w AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
u AS (SELECT side, doc_id, unnest(ws) AS word FROM w),
k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM u)),
b AS (SELECT word, list_transform(range(len(hx) // 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1) AS bytes FROM d),
c AS (SELECT word, xor(list_reduce(list_concat([4294967295], bytes), lambda r, x: xor(r >> 8, tab[(xor(r, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM b, k),
f AS (SELECT side, doc_id, bucket FROM u JOIN c USING (word)),
n AS (SELECT count(*) FILTER (side = 0) AS s_all, count(*) FILTER (side = 1) AS t_all FROM f),
g AS (SELECT bucket, floor(1000 * ln((count(*) FILTER (side = 1) + 1)::DOUBLE * (any_value(s_all) + 10000) / ((count(*) FILTER (side = 0) + 1)::DOUBLE * (any_value(t_all) + 10000))))::BIGINT AS gain FROM f, n GROUP BY bucket),
p AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM documents d LEFT JOIN p USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank, n_features AS n_words FROM r""")
def op13(spark, sf_dir):
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
