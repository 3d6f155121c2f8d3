"""Token counts, files and packing against the libraries; mixing against its bound."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import empty, odd_texts, prose, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import coding, mixing, packing, token_counts, token_files

TEXTS = [*odd_texts(), "It's I'll don't 123 1a2", "Ab.\nCd x,\ny z.\n\nq a\n b", "<|ENDOFTEXT|>", " a  b   c ", "a\tb\x1cc", "İSTANBUL Σας ΑΣ", "| || a|b", "café. É, é.",
         "word***, a--b c.!? d_e f_ g(h) i). j,&&& k's. l.'s m<|endoftext|>, n\\ o| p;: q\u2003r \u00a0s t\u00a0 u x'll! y'Z", "Foo\nBAR\nbaz. É\né", "Ǆ ǆ Ǆ. ſtraße ŉ ĳ K Å. é́"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_coder(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for cache in (400_000, 7):
        own = coding.Coder(public_tokenizers.path(name), name.startswith("word_"), cache)
        for t in [x or "" for x in TEXTS] * 2:
            assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:50]


def test_variable_length_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 33, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


@pytest.mark.parametrize("file_ids", [2_000_000, 3000])
def test_token_files(spark, tmp_path, file_ids):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    token_files.write(token_files.encoded(table(spark, TEXTS).repartition(3)), str(tmp_path / "t"), file_ids)
    got = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "t")).collect()}
    start = 0
    for d, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    # files in order of their names hold documents in order
    files = sorted((tmp_path / "t" / "data").glob("part-*"))
    order = [i for f in files for _, ids, _, _ in token_files.read_records(f.read_bytes()) for i in ids.tolist()]
    assert order == list(range(len(TEXTS))) and (file_ids > 5000 or len(files) > 1)


def test_token_files_odd_rows(spark, tmp_path):
    token_files.write(token_files.encoded(empty(spark)), str(tmp_path / "e"))
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0
    docs = table(spark, ["b", "a", None]).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.lit(5)))
    token_files.write(token_files.encoded(docs), str(tmp_path / "n"))
    assert sorted((r.start, r.doc_id) for r in token_files.read(spark, str(tmp_path / "n")).collect()) == [(0, None), (1, 5), (3, 5)]


@pytest.mark.parametrize("size", [50_000, 5, 0])
def test_token_counts(spark, size):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.count(table(spark, TEXTS), limit=100, table=size).collect()}
    for d, t in enumerate(TEXTS):
        n = len(library.encode(t or ""))
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), n, n > 100), (t or "")[:50]
    assert token_counts.count(empty(spark)).count() == 0


def test_token_counts_long_words(spark):
    """Copies of one long text without spaces: more tokens than two bytes hold, and nothing of it in the table."""
    long = "".join(chr(0x4E00 + i % 5000) for i in range(70_000))
    docs = table(spark, [long, long, "a few words", "a few words"]).coalesce(1)
    model = token_counts.counter(token_counts.MODEL).model
    got = {r.doc_id: r.n_tokens for r in token_counts.count(docs).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate([long, long, "a few words", "a few words"])} and got[0] > 65_535
    assert max(len(w.encode()) for w in token_counts.frequent(docs)) <= token_counts.WORD_BYTES


@pytest.mark.parametrize("length", [1024, 64])
def test_packing(spark, length):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(table(spark, TEXTS), length=length).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(empty(spark)).count() == 0


def test_plan_meets_demand():
    rng = np.random.default_rng(3)
    for top in (1, 5, 200, 20_000):
        demand = np.zeros(256, np.int64)
        demand[:128] = rng.integers(0, top + 1, 128)
        plan = packing.plan_patterns(demand)
        units = np.arange(256) + 1
        assert (sum((n * p for p, n in plan), np.zeros(256, np.int64)) == demand).all() and all((p * units).sum() <= 256 for p, _ in plan)
        used, least = sum(n for _, n in plan), -(-(demand * units).sum() // 256)
        assert used <= 1.01 * least + 3
    assert packing.plan_patterns(np.zeros(8, np.int64)) == []


def test_best_pattern_is_best():
    rng = random.Random(4)
    for _ in range(30):
        prices = np.array([rng.random() for _ in range(7)])

        def best(room, i):
            return 0.0 if i == 7 or room <= 0 else max(k * prices[i] + best(room - k * (i + 1), i + 1) for k in range(room // (i + 1) + 1))
        worth, counts = packing.best_pattern(prices, 12)
        assert abs(worth - best(12, 0)) < 1e-9 and abs(counts @ prices - worth) < 1e-9 and counts @ (np.arange(7) + 1) <= 12


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 997, "b": 2, "c": 1}, {f"s{i}": i + 1 for i in range(12)}])
def test_schedule_deviates_by_less_than_a_block(weights):
    slots = mixing.period(weights)
    total = sum(weights.values())
    assert sorted(t for s in slots.values() for t in s) == list(range(total))
    for name, w in weights.items():
        for t in range(1, total + 1):
            assert abs(sum(s < t for s in slots[name]) - w * t / total) < 1


def test_mixing(spark):
    rng = random.Random(1)
    docs = table(spark, [prose(rng, 3) for _ in range(700)], source=lambda j: None if j % 10 == 9 else "big" if j % 3 else f"s{j % 4}")
    weights = {"big": 1, "s0": 3, None: 2}
    rows = mixing.scheduled(docs, weights, block_rows=4).collect()
    assert sorted(r.row.doc_id for r in rows) == list(range(700))
    blocks = {}
    for r in rows:
        assert r.block == r.source_rank // 4
        assert blocks.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(blocks) == list(range(len(blocks)))
    for source in {r.source for r in rows}:
        mine = sorted((r.source_rank, r.row.doc_id) for r in rows if r.source == source)
        assert [k for k, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)
    # phase by phase, the sources that still have blocks get their share
    left, counts, start = {s: sum(b[0] == s for b in blocks.values()) for s in {b[0] for b in blocks.values()}}, {}, 0
    share = {s: weights.get(s, 1) for s in left}
    counts = dict.fromkeys(left, 0)
    for t in range(len(blocks)):
        source = blocks[t][0]
        counts[source] += 1
        whole = sum(share[s] for s in left)
        assert all(abs(counts[s] - share[s] * (t + 1 - start) / whole) < 1 for s in left)
        left[source] -= 1
        if not left[source]:
            del left[source]
            counts, start = dict.fromkeys(left, 0), t + 1
    mixed = mixing.mix(docs, weights, 4)
    assert mixed.columns == docs.columns
    order = [r.doc_id for r in mixed.collect()]
    slot = {r.row.doc_id: (r.slot, r.source_rank) for r in rows}
    assert order == sorted(order, key=slot.get)
    assert mixing.mix(empty(spark)).count() == 0
    again = mixing.mix(docs.union(docs))
    assert again.count() == 1400


def test_caches_are_bounded_in_bytes():
    """Keys, values and dictionaries of a cache stay within its bytes whatever comes, values stay right, long texts aren't kept."""
    from shelfmark.llm import coding

    cache = coding.Bounded(lambda new: [x.encode() * 2 for x in new], 200_000)
    rng = random.Random(4)
    for _ in range(400):
        parts = [rng.choice(["the", "of", "x" * rng.randrange(5000), "é" * rng.randrange(900), f"w{rng.randrange(10 ** 6)}"]) for _ in range(30)]
        assert cache.values(parts) == [x.encode() * 2 for x in parts]
        held = {**cache.now, **cache.late}
        assert sum(coding.ENTRY + len(x.encode()) + len(v) for x, v in held.items()) <= 200_000
    assert "the" in cache.now and max(len(v) for v in held.values()) < 2000


def test_bounded_values_come_in_order_and_stay_bounded():
    from shelfmark.llm import coding

    asked = []
    bound = coding.Bounded(lambda new: [asked.append(x) or x.encode() for x in new], 40_000)
    for k in range(400):
        parts = [f"w{k % 90}", "é" * (k % 7 + 1), f"w{k % 90}", f"only{k}"]
        assert [v.decode() for v in bound.values(parts)] == parts
        held = sum(coding.ENTRY + len(x.encode()) + len(v) for store in (bound.now, bound.late) for x, v in store.items())
        assert held <= 40_000
    assert len(asked) < 400 + 90 * 4 + 7 * 4


def test_bounded_caches_take_bytes():
    """Words in bytes, as near dedup looks them up, in a cache with room, one that is full, and beyond what is kept."""
    from shelfmark.llm import coding

    for size in (1 << 20, 30_000):
        cache = coding.Bounded(lambda new: [x[::-1] for x in new], size)
        for k in range(300):
            parts = [b"the", "é".encode() * (k % 7 + 1), b"only%d" % k, b"\xff\x00" * k * 10]
            assert cache.values(parts) == [x[::-1] for x in parts]
            assert sum(coding.ENTRY + len(x) + len(v) for x, v in {**cache.now, **cache.late}.items()) <= size
        assert b"the" in cache.now
