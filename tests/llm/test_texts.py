"""Fingerprints, sharding and toxicity."""

import hashlib
import math
import random

import numpy as np
import pytest
from helpers import empty, odd_texts, prose, shingles, table
from pyspark.sql import functions as F

from shelfmark.llm import fingerprints as FP
from shelfmark.llm import sharding, toxicity
from shelfmark.llm.common import in_order


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_edited_texts(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in FP.compare_edited(table(spark, texts), k=4096).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        # below k shingles, likeness is exact
        assert r.near_edited == pytest.approx(jaccard(shingles(t, 5), shingles(edited, 5))) if len(shingles(t, 5) | shingles(edited, 5)) <= 4096 else True
        assert r.near_next == pytest.approx(jaccard(shingles(t, 5), shingles(after, 5))) if len(shingles(t, 5) | shingles(after, 5)) <= 4096 else True
        assert r.n_shingles == len(shingles(t, 5)) if len(shingles(t, 5)) < 4096 else True
    assert got[8].fingerprint == got[9].fingerprint


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(3)
    one, two = prose(rng, 3000), prose(rng, 3000)
    cases = [(one, one), (one, two), (one, one[: len(one) // 2]), (one[: len(one) // 2], one), (one, one[: len(one) // 2] + two[: len(two) // 2])]
    df = spark.createDataFrame([(i, a, b, a + " " + b) for i, (a, b) in enumerate(cases)], "id int, a string, b string, ab string")
    for c in ("a", "b", "ab"):
        df = FP.with_sketch(df, c, f"{c}_s", 128)
    rows = df.select("id", FP.resemblance(F.col("a_s"), F.col("b_s")).alias("r"), FP.containment(F.col("a_s"), F.col("b_s")).alias("c"), FP.distinct_count(F.col("a_s")).alias("n"),
                     FP.resemblance(FP.merged(F.col("a_s"), F.col("b_s")), F.col("ab_s")).alias("m")).collect()
    for r in rows:
        a, b = (shingles(t, 5) for t in cases[r.id])
        assert abs(r.r - jaccard(a, b)) < 0.17 and abs(r.c - len(a & b) / len(a)) < 0.3 and abs(r.n / len(a) - 1) < 0.3
        assert r.m > 0.9  # but for the shingles across the border
    parts = df.select(F.lit("g").alias("g"), "a_s").where("id < 2").union(df.select(F.lit("g"), "b_s").where("id < 2"))
    whole = FP.merge_rows(parts, ["g"], "a_s").first()
    every = sorted({h for row in parts.collect() for h in row.a_s})[:128]
    assert whole.a_s == every


def test_fingerprints_odd_rows(spark):
    docs = table(spark, ["a b c d e f", "a b c d e g", "z"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.lit(3)))
    got = FP.compare_edited(docs).collect()
    assert sorted((r.doc_id or -1, r.near_next is None) for r in got) == [(-1, True), (3, False), (3, False)]
    assert FP.compare_edited(empty(spark)).count() == 0
    alone = FP.compare_edited(table(spark, ["just one text here now"])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 22


def test_order_over_a_table(spark):
    texts = [f"{i}" for i in random.Random(1).sample(range(500), 500)]
    rows = in_order(table(spark, texts).select("doc_id", "text", F.lit("hot").alias("name")), "name", "doc_id").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r["slice"], r["at"]))] == list(range(500))
    assert len({r["slice"] for r in rows}) > 1


@pytest.mark.parametrize("limit", [500, 3000, 10 ** 9])
def test_shards(spark, tmp_path, limit):
    texts = odd_texts()
    docs = table(spark, texts)
    buckets = {r.shard: r for r in sharding.write_shards(docs, str(tmp_path / "s"), limit).collect()}
    rows = spark.read.parquet(str(tmp_path / "s")).select("shard", "row.*" if False else "row").collect()
    assert sorted((r.row.doc_id, r.row.text or "", r.row.shard) for r in rows) == [(i, t or "", "s") for i, t in enumerate(texts)]
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(len((r.row.text or "").encode()))
    assert {s: (len(x), sum(x)) for s, x in held.items()} == {s: (b.shard_docs, b.shard_bytes) for s, b in buckets.items()}
    for s, b in buckets.items():
        assert b.oversized == (b.shard_bytes > limit) and (not b.oversized or b.shard_docs == 1)
        # no shard is a prefix of another
        assert not any(o != s and o.startswith(s) for o in buckets)


def test_shards_odd_rows(spark, tmp_path):
    docs = table(spark, ["same" * 100] * 4).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.lit(3)))
    got = sharding.write_shards(docs, str(tmp_path / "s"), 500).collect()
    assert sorted((b.shard_docs, b.oversized) for b in got) == [(2, True), (2, True)]
    assert sharding.directory(empty(spark))[0].count() == 0


@pytest.mark.parametrize("size, least, right", [("0.001", 0.0, 0.8), ("0.01", 0.45, 0.9), ("0.1", 0.35, 0.92)])
def test_toxicity_held_out(spark, size, least, right):
    """Fitted on half of the labels, held against the others: shares of toxic ones caught and of right answers, and clean ones lost.

    The smallest table has three toxic texts to learn from, and no word that they share beyond chance: nothing is called
    toxic there. In the others some two fifths of the toxic texts have none of the words that tell elsewhere.
    """
    d = f"/root/testdata/sf{size}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in toxicity.grade(docs, half).collect()}
    assert len(got) == docs.count()
    rest = [r for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in got]
    caught = sum(got[r.doc_id].toxic for r in rest if r.toxic)
    assert caught >= least * sum(r.toxic for r in rest) and sum(got[r.doc_id].toxic == bool(r.toxic) for r in rest) >= right * len(rest)
    assert sum(got[r.doc_id].toxic for r in rest if not r.toxic) < 0.01 * len(rest)
    assert all(0 <= r.severity <= 2 for r in got.values())


def test_toxicity_scores_every_row(spark):
    """Spark's scores, severities and verdicts against the model's weights summed plainly."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    assert len(model.weights) > 5
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = toxicity.score(docs, model).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        words = toxicity.words_of(texts[r.doc_id])
        score = sum(model.weights.get(x, 0.0) for x in words | {w[:n] + "*" for w in words for n in toxicity.PREFIXES if len(w) > n})
        assert r.score == pytest.approx(score, abs=1e-9) and r.toxic == (r.score >= model.cut)
        assert r.severity == pytest.approx(sum(1 / (1 + math.exp(t - score)) for t in model.thresholds), abs=1e-9)


def test_toxicity_slopes():
    """Slopes of the likelihood by scores and by thresholds against differences."""
    rng = np.random.default_rng(2)
    for grades in (2, 3, 4):
        y, score, theta = rng.integers(0, grades, 30), rng.normal(size=30), rng.normal(size=grades - 1)
        value, of_score, of_theta = toxicity._loss(score, y, theta, grades)
        for i in range(30):
            up = score.copy()
            up[i] += 1e-6
            assert (toxicity._loss(up, y, theta, grades)[0] - value) / 1e-6 == pytest.approx(of_score[i], abs=1e-5)
        for i in range(grades - 1):
            up = theta.copy()
            up[i] += 1e-6
            assert (toxicity._loss(score, y, up, grades)[0] - value) / 1e-6 == pytest.approx(of_theta[i], abs=1e-4)


def test_ordinal_grades():
    """Three grades by how many telling words a text has: one set of weights orders all."""
    rng = random.Random(6)
    rows = []
    for _ in range(600):
        g = rng.randrange(3)
        words = {f"w{rng.randrange(300)}" for _ in range(20)} | set(rng.sample(["vile", "foul", "rotten", "nasty"], 2 * g))
        rows.append((g, " ".join(sorted(words))))
    model = toxicity.fit(rows[:400], penalty=1e-3)
    assert model.thresholds == sorted(model.thresholds) and {"vile", "foul", "rotten", "nasty"} <= set(model.weights)
    means = [[float(model.severity(model.score(set(t.split())))) for y, t in rows[400:] if y == g] for g in range(3)]
    means = [sum(m) / len(m) for m in means]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (999, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.grade(table(spark, odd_texts()), labels).collect()
    assert len(got) == len(odd_texts()) and not any(r.toxic for r in got)
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    assert toxicity.grade(empty(spark), some).count() == 0
    assert toxicity.grade(table(spark, odd_texts()), some).count() == len(odd_texts())
