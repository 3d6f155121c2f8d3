"""Clustering by subvector dictionaries against plain k-means on whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from shelfmark.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance string, values string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", "d", "v", "i") for i, v in rows], SCHEMA)


def plain(rows, k, rounds, seed, dimensions, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            q = [max(-C.MOST, min(C.MOST, math.floor(float(np.float32(x)) * scale))) for x in v]
            kept.append((i, q))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cent = [q for _, q in first]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for j, g in groups.items():
            cent[j] = [sum(x) // len(g) for x in zip(*g)]
    placed = [(i, *near(q)[::-1]) for i, q in kept]
    by = {}
    for _, j, d in placed:
        by[j] = by.get(j, 0) + d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(map(str, [(i, j, d, by[j], sum(by.values()), shas[j]) for i, j, d in placed]))


def rows_of(seed, n, dimensions, levels):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-levels, levels) / 300 for _ in range(dimensions)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 3)]  # one vector that many hold
    return rows


def got(df, **kw):
    return sorted(str((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in C.cluster(df, **kw).collect())


@pytest.mark.parametrize("dimensions, levels, chunk", [(64, 100, 1 << 15), (10, 3, 50), (1, 9, 7)])
def test_against_plain(spark, monkeypatch, dimensions, levels, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = rows_of(dimensions, 150, dimensions, levels)
    args = {"k": 7, "rounds": 3, "seed": 5, "dimensions": dimensions, "scale": 256}
    assert got(table(spark, rows), **args) == plain(rows, **args)


def test_odd_rows(spark):
    good = rows_of(1, 12, 4, 50)
    odd = [(100, None), (101, []), (102, [1.0, 2.0, None, 4.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]),
           (105, [1.0] * 5), (None, [0.5, 0.25, -0.5, 1.0]), (2, [3.0, 3.0, 3.0, 3.0]), (2, [3.0, 3.0, 3.0, 3.0]), (106, [1e30, -1e30, 0.0, 1e-30])]
    args = {"k": 40, "rounds": 2, "seed": 2, "dimensions": 4, "scale": 256}
    assert got(table(spark, good + odd), **args) == plain(good + odd, **args)
    few = {**args, "k": 3}
    assert got(table(spark, good[:2]), **few) == plain(good[:2], **few)
    assert C.cluster(table(spark, []), dimensions=4).count() == 0
    assert C.cluster(table(spark, odd[:5]), dimensions=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("levels, widest", [(2, 16), (1000, 2)])
def test_encoding_is_lossless_and_follows_the_data(levels, widest):
    rng = np.random.default_rng(levels)
    values = rng.integers(0, levels, (60, 16)).astype(np.int32)
    values = np.concatenate([values] * 20)
    if levels == 1000:
        values = rng.integers(0, 40, (30_000, 16)).astype(np.int32)
    for width in C.WIDTHS:
        blocks, codes = C.encoded(values, width)
        assert (np.concatenate([b[c] for b, c in zip(blocks, codes)], 1) == values).all()
        assert all(len(np.unique(b, axis=0)) == len(b) for b in blocks)
    width = C.best_encoding(values, 40)[0][0].shape[1]
    assert width >= widest if levels == 2 else width <= widest
