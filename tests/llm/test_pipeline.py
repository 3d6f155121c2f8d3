"""The stages of the pipeline, each held against a plain version on its own input."""

import random
import re

from helpers import shingles
from test_dedup import components_of

import corpus_pipeline
from shelfmark.llm import exact_dedup, near_dedup, toxicity

D = "/root/testdata/sf0.001"


def plain_score(model, text):
    """Weights of a text's words and word beginnings, each counted once."""
    words = toxicity.words_of(text)
    return sum(model.weights.get(x, 0.0) for x in words | {w[:n] + "*" for w in words for n in toxicity.PREFIXES if len(w) > n})


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{D}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        seen[name] = [r.asDict() for r in docs.collect()], [r.asDict() for r in spark.read.parquet(str(tmp_path / name)).collect()]
        docs = spark.read.parquet(str(tmp_path / name))
    # the fitted model's scores, computed anew from its weights
    rows, left = seen["toxicity"]
    model = toxicity.fit(toxicity.labelled(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")))
    assert sorted(r["doc_id"] for r in left) == sorted(r["doc_id"] for r in rows if r["text"] is None or plain_score(model, r["text"]) < model.cut)
    rows, left = seen["exact dedup"]
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert {r["doc_id"] for r in left} == set(first.values())
    rows, left = seen["near dedup"]
    near = components_of({r["doc_id"]: shingles(r["text"], 5, lower=True) for r in rows}, 80, 100)
    assert {r["doc_id"] for r in left} == {d for d, c in near.items() if c == d}
    rows, left = seen["mixing"]
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in left)
    rows, left = seen["packing"]
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in left}


def test_repeated_ids(spark):
    """Rows that share an id, or have none, are judged by their own text, and one row of a group stays."""
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randrange(10_000)}" for _ in range(60)) for x in "abc")
    rows = [(3, a), (5, a + " end"), (5, b), (7, c), (7, c), (None, c + " more"), (None, b + " too"), (None, None), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = near_dedup.deduplicate(docs).collect()
    assert sorted(map(str, near)) == sorted(map(str, spark.createDataFrame([(3, a), (5, b), (7, c), (None, None), (None, "alone here")], docs.schema).collect()))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (7, a.replace(" ", "  ")), (None, c), (None, b), (None, "x"), (None, "x"), (2, "y"), (2, "y ")]
    exact = exact_dedup.deduplicate(spark.createDataFrame(rows, docs.schema)).collect()
    assert sorted(map(str, exact)) == sorted(map(str, spark.createDataFrame([(3, a), (5, b), (7, c), (None, "x"), (2, "y"), (2, "y ")], docs.schema).collect()))


def test_toxic_by_row(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["plain", "calm", "river", "stone", "door"]) + str(rng.randrange(9)) for _ in range(30)) + (" vileword" if i % 3 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 2)) for i in range(600)], "doc_id long, toxic long, quality long")
    odd = [(-1, texts[0]), (-1, texts[1]), (None, texts[3]), (None, texts[4]), (-2, None)]
    docs = spark.createDataFrame([*enumerate(texts), *odd], "doc_id long, text string")
    left = toxicity.clean(docs, labels).where("doc_id IS NULL OR doc_id < 0").collect()
    assert sorted(map(str, left)) == sorted(map(str, spark.createDataFrame([odd[1], odd[3], odd[4]], docs.schema).collect()))


def test_sequences_follow_the_mixture(spark, tmp_path):
    """Shares of sources along sequence_id are those along the mixture, with a hot source and documents of all lengths."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([20, 90, 300, 1500]))), f"s{0 if i % 3 else i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    corpus_pipeline.mixed(spark, docs, D).write.option("maxRecordsPerFile", 45).parquet(str(tmp_path / "mixed"))
    files = sorted(tmp_path.glob("mixed/part-*.parquet"))
    at = {d: i for i, d in enumerate(r.doc_id for f in files for r in spark.read.parquet(str(f)).select("doc_id").collect())}
    got = corpus_pipeline.packed(spark, spark.read.parquet(str(tmp_path / "mixed")), D).collect()
    ids = sorted({r.sequence_id for r in got})
    assert ids == list(range(len(ids)))
    source = {i: s for i, _, s in rows}
    whole = sum(r.length for r in got)
    tokens = {}
    for r in got:
        tokens[at[r.doc_id]] = r.doc_tokens
    seen, mixture = 0, {}
    for d, i in sorted(at.items(), key=lambda x: x[1]):
        mixture[d], seen = seen / whole, seen + tokens[i]
    for quarter in range(4):
        def share(chosen, name):
            total = sum(n for n, _ in chosen)
            return sum(n for n, s in chosen if s == name) / total
        mine = [(r.length, source[r.doc_id]) for r in got if r.sequence_id * 4 // len(ids) == quarter]
        planned = [(tokens[at[d]], source[d]) for d in at if int(mixture[d] * 4) == quarter]
        assert all(abs(share(mine, name) - share(planned, name)) < 0.1 for name in set(source.values())), quarter


SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, _metadata string, part long, row long, `key` string, kept int"


def staged(spark, rows, tmp_path):
    """Every stage on what the one before it kept, over documents with clashing columns."""
    docs, out = spark.createDataFrame([(i, t, "en", s, None, "m", 1, 2, "k", 3) for i, t, s in rows], SHAPE), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.columns, [r.asDict() for r in docs.collect()]
    return out


def test_odd_rows_through_all_stages(spark, tmp_path):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (4, long + " more", None), (5, "x" * 300_000, "b"), (5, "other text of this id", "b"), (6, "tie of texts", "a"),
            (7, "tie  of texts", "a"), (7, "tie  of texts", "a"), (None, "no id but a text", None), (None, None, None)]
    out = staged(spark, rows, tmp_path)
    for name in ("toxicity", "exact dedup", "near dedup", "mixing"):
        assert out[name][0] == [c.split()[0].strip("`") for c in SHAPE.split(", ")]
    assert len(out["toxicity"][1]) == len(rows)
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in out["mixing"][1])
    assert texts == sorted([(1, ""), (3, long), (5, "x" * 300_000), (5, "other text of this id"), (6, "tie of texts"), (-1, "no id but a text")])
    pieces = out["packing"][1]
    assert {r["doc_id"] for r in pieces} == {1, 3, 5, 6, None} and sum(r["start"] == 0 for r in pieces) == 6


def test_empty_table_through_all_stages(spark, tmp_path):
    out = staged(spark, [], tmp_path)
    assert all(not rows for _, rows in out.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
