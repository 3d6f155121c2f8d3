"""Resampling against a plain version with zlib and dictionaries."""

import hashlib
import math
import random
import re
import zlib

import pytest
from helpers import empty, odd_texts, prose, table

from shelfmark.llm import resampling as R


def grams(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(texts, target, percent, n, buckets, seed, least_words):
    def count(many):
        out = {}
        for t in many:
            for g in grams(t, n)[1]:
                b = zlib.crc32(g.encode()) % buckets
                out[b] = out.get(b, 0) + 1
        return out
    s, t = count(texts), count(target)
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, text in enumerate(texts):
        n_words, gs = grams(text, n)
        weight = 0
        for g in gs:
            b = zlib.crc32(g.encode()) % buckets
            weight += math.floor(1000 * math.log((t.get(b, 0) + 1) * (S + buckets) / ((s.get(b, 0) + 1) * (T + buckets))))
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted((i, f, w, sc, rank.get(i), nw) for i, f, w, sc, nw in rows)


@pytest.mark.parametrize("n, block, buckets", [(1, 2 << 20, 10_000), (3, 700, 97)])
def test_against_plain(spark, monkeypatch, n, block, buckets):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(n)
    # the two words' checksums share their last bits; a very long word; words next to marks, other scripts and edges
    texts = [*odd_texts(), "É" * 40_000 + " ab", "-".join(["Naïve"] * 50), "漢字" * 200 + " 漢字", "x" * 70_001, "9" * 256 + " " + "9" * 257, *[prose(rng, 60) for _ in range(60)]]
    target = [prose(rng, 30) + " stone stone door", "", None, "window glass " * 20]
    args = {"percent": 30, "n": n, "buckets": buckets, "seed": 7, "least_words": 20}
    got = R.resample(table(spark, texts), table(spark, target), **args).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r["score"], r["rank"], r.n_words) for r in got) == plain(texts, target, **args)
    assert max(r["rank"] or 0 for r in got) > 15


def test_odd_rows(spark):
    assert R.resample(empty(spark), table(spark, ["a b"])).count() == 0
    got = R.resample(table(spark, [None, "", "one two"]), empty(spark), least_words=1, percent=100).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(0, 0, None), (1, 0, None), (2, 2, 1)]
    text = " ".join(["word"] * 25)
    docs = table(spark, [text] * 6).selectExpr("CASE WHEN doc_id < 2 THEN 5 WHEN doc_id < 4 THEN NULL ELSE doc_id END AS doc_id", "text", "1 AS bucket", "2 AS rank", "'s' AS score")
    got = R.resample(docs, table(spark, [text]), percent=50).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert len({r["score"] for r in got if r.doc_id is None}) == 1 and len({r["score"] for r in got if r.doc_id == 5}) == 1
