"""Clustering around centroids with subvector dictionaries: exact k-means on whole numbers.

Vectors are dealt out in chunks. In a chunk every block of dimensions is dictionary-encoded without loss: its distinct
subvectors, and a code a vector. A round computes the distance of each distinct subvector to each centroid once and sums
these by code; the centroids' new sums come from counts of codes in the same way. Chunks choose the width of their blocks
by what a round costs: wide blocks where vectors repeat, narrow ones where only single values do. Chunks are written
once; a round reads codes and dictionaries, sends the centroids out and gets sums of bounded size back.

All numbers are whole (components times ``SCALE``, rounded down), so distances, ties and means are exact, whatever the
order rows are read in.

Cases: vectors of another length, with a null or non-finite component, or null, are left out; components beyond
``MOST`` after scaling count as that much; rows that repeat an id are vectors of their own; a row without an id is
clustered and starts no centroid unless too few others do; with fewer vectors than centroids there are as many centroids
as vectors; an empty table gives an empty result. An inertia beyond 64 bits is null. Further columns stay out of the way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .registry import query

DIMENSIONS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: bound on a scaled component: squared distances then fit in 64 bits
MOST = 1 << 27
#: vectors a chunk; codes are 16 bits wide
CHUNK = 1 << 15
WIDTHS = (1, 2, 4, 8, 16)


def kept(vectors: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, values) of the usable vectors, in whole numbers."""
    v = F.col("values")
    usable = (F.size(v) == dimensions) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * float(scale)), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("values"))
    return rows.where(v.isNotNull()).where(usable).select("vec_id", whole.alias("values"))


def encoded(values: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct subvectors of every block of ``width`` dimensions, and the codes (blocks x vectors)."""
    n, dimensions = values.shape
    blocks, codes = [], np.empty((-(-dimensions // width), n), np.uint16)
    for b, at in enumerate(range(0, dimensions, width)):
        part = np.ascontiguousarray(values[:, at:at + width])
        size = part.shape[1] * part.itemsize
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(part)]).dictionary_encode()
        blocks.append(np.frombuffer(coded.dictionary.buffers()[1], part.dtype, len(coded.dictionary) * part.shape[1]).reshape(-1, part.shape[1]))
        codes[b] = coded.indices.to_numpy()
    return blocks, codes


def best_encoding(values: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The encoding whose rounds cost least: distances of all distinct subvectors, and one addition a vector and block."""
    every = [encoded(values, w) for w in WIDTHS if w <= values.shape[1]]
    return min(every, key=lambda e: sum(2 * b.size for b in e[0]) * k + e[1].size * k)


CHUNKS = "ids binary, absent binary, sizes binary, dictionary binary, codes binary"


def chunks(rows: DataFrame, dimensions: int, k: int) -> DataFrame:
    """A table of encoded chunks."""
    def dealt(batches):
        def made(ids, absent, values):
            blocks, codes = best_encoding(values, k)
            sizes = np.array([b.shape for b in blocks], "<i4")
            flat = np.concatenate([b.ravel() for b in blocks]).astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), absent, sizes, flat, codes)], ["ids", "absent", "sizes", "dictionary", "codes"])

        held, n = [], 0
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dimensions)
            absent = np.array(batch.column(0).is_null())
            held.append((batch.column(0).fill_null(0).to_numpy(), absent, values))
            n += len(absent)
            while n >= CHUNK:
                ids, absent, values = (np.concatenate(x) for x in zip(*held))
                yield made(ids[:CHUNK], absent[:CHUNK], values[:CHUNK])
                held, n = [(ids[CHUNK:], absent[CHUNK:], values[CHUNK:])], n - CHUNK
        if n:
            yield made(*(np.concatenate(x) for x in zip(*held)))

    return cut(rows.mapInArrow(dealt, CHUNKS))


def opened(batches):
    """(ids, absent, dictionaries of the blocks, codes) of every chunk."""
    for batch in batches:
        for ids, absent, sizes, flat, codes in zip(*(c.to_pylist() for c in batch.columns)):
            ids, flat = np.frombuffer(ids, "<i8"), np.frombuffer(flat, "<i4")
            blocks, at = [], 0
            for rows, width in np.frombuffer(sizes, "<i4").reshape(-1, 2).tolist():
                blocks.append(flat[at:at + rows * width].reshape(rows, width).astype(np.int64))
                at += rows * width
            yield ids, np.frombuffer(absent, bool), blocks, np.frombuffer(codes, np.uint16).reshape(len(blocks), len(ids))


def nearest(blocks: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of every vector, by sums of the distances of its codes."""
    total, at = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for block, code in zip(blocks, codes):
        apart = np.zeros((len(block), len(centroids)), np.int64)
        for j in range(block.shape[1]):
            apart += (block[:, j, None] - centroids[None, :, at + j]) ** 2
        total += apart[code]
        at += block.shape[1]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dimensions = centroids.shape

    def summed(batches):
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for _, _, blocks, codes in opened(batches):
            best, at = nearest(blocks, codes, centroids)[0], 0
            counts += np.bincount(best, minlength=k)
            for block, code in zip(blocks, codes):
                times = np.bincount(best * len(block) + code, minlength=k * len(block)).reshape(k, -1)
                sums[:, at:at + block.shape[1]] += times @ block
                at += block.shape[1]
        some = np.flatnonzero(counts)
        columns = np.repeat(some, dimensions), np.tile(np.arange(dimensions), len(some)), sums[some].ravel(), np.repeat(counts[some], dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "dimension", "total", "n"])

    rows = table.mapInArrow(summed, "cluster long, dimension long, total long, n long")
    out = centroids.copy()
    # a row a centroid and dimension
    for r in rows.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["dimension"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    ship(spark)
    rows = kept(vectors, dimensions, scale, id_col, vector_col)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # as many rows as there are centroids
    start = rows.orderBy(F.asc_nulls_last(first), "values").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["values"] for r in start], np.int64)
    table = chunks(rows, dimensions, k)
    for _ in range(rounds):
        centroids = moved(table, centroids)

    def assigned(batches):
        for ids, absent, blocks, codes in opened(batches):
            best, distance = nearest(blocks, codes, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=absent), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = cut(table.mapInArrow(assigned, schema))
    inertia = {r["cluster"]: r["x"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}

    def fitting(x):
        return int(x) if x < 1 << 63 else None

    whole = fitting(sum(inertia.values()))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, fitting(x), whole, shas[c]) for c, x in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    near = """SELECT n, vec_id, q, min(struct_pack(d := list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c), k := k)) AS m FROM v, c{i} GROUP BY n, vec_id, q"""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, q AS c FROM v QUALIFY k < {CENTROIDS})"]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        parts.append(f"s{i} AS (SELECT k, list(x ORDER BY j) AS c FROM (SELECT m.k AS k, j, floor(sum(q[j]) / count(*)) AS x FROM a{i}, range(1, {DIMENSIONS + 1}) r(j) GROUP BY m.k, j) GROUP BY k)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(s.c, o.c) AS c FROM c{i} o LEFT JOIN s{i} s ON s.k = o.k)")
    parts.append(f"f AS MATERIALIZED ({near.format(i=ROUNDS)})")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, m.k::INT AS cluster, m.d::BIGINT AS distance, sum(m.d) OVER (PARTITION BY m.k)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM f JOIN c%d c ON c.k = m.k""" % ROUNDS


@query("op11_centroids", _oracle())
def op11(spark, sf_dir):
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
