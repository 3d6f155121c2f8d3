"""MinHash near-dedup by an LSH forest: documents in several sorted signature orders, neighbours by longest common prefix.

Order t of n sorts signatures by their labels from position t x HASHES / n on (going round), range-partitioned over the
whole table. One pass over a sorted partition gives each document's candidates: its neighbours going outwards, as long as the common
prefix (the running minimum of the prefixes of adjacent rows) has ``LEAST`` labels, ``NEAR`` of them to either side. Rows
at the borders of partitions are handed over. In a sparse place that reaches down to the shortest prefix; in a crowded
one the neighbours are those with the longest prefixes, so depth adapts to how crowded a region is, no region is joined
with itself, and an order gives a document at most 2 x NEAR candidates.

Where the neighbours end at a long prefix, a partner may lie further out. How far they reached in each order gives the
chance of having missed a partner at the threshold; documents for which it is above ``MISS`` are crowded, and either end
of a missed pair is. Among them every link between two components is found exactly (``crowded_links``): texts at the
threshold share one of the first (1 - threshold) x size shingles in order of rarity, so only documents that such shingles
connect are compared, all of them with all, in blocks of bounded size that many tasks take, each giving no more than the
components that its links join.

Outside crowded places a pair at the threshold is missed by all orders with a chance below ``MISS``, and by the check of
signatures with 3e-10. Where a crowded place is large and stays apart, its comparison grows with the square of the place.

Documents with equal shingle sets are one class and searched once. Neighbours that stand next to each other in some of the
orders are confirmed on full shingle sets first; a second pass over the orders gives the candidates whose ends are still
apart and not both crowded. Those whose signatures agree too little to reach the threshold are dropped (``SLACK`` below
it, some seven standard deviations). Documents, links and components stay in tables.

Cases: a null, empty or blank text has no shingle and is linked with nothing; a text with fewer words than a shingle
has one, all its words; equal sets are linked whatever the texts; rows that repeat an id are one document for linking
and each keep their row; a row without an id is linked with nothing, has no component and is kept; an empty table
gives an empty result. Texts are read whole, however long; further columns stay out of the way.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import cut

from .coding import Bounded, release
from .common import documents, narrow, shuffle_partitions, ship
from .components import components
from .registry import query

SHINGLE = 3
#: links: SHARE[1] x intersection >= SHARE[0] x union
SHARE = (85, 100)
TREES = 20
HASHES = 100
#: labels of an order that rows are sorted and compared by, and the fewest that candidates share
DEPTH, LEAST = 16, 2
#: neighbours to either side in an order
NEAR = 8
#: chance of a missed partner at the threshold above which a document is compared exactly
MISS = 1e-8
#: neighbours in every STEP-th order are confirmed first
STEP = 2
SLACK = 0.25
#: documents and shingles of a block of crowded documents (a longer document is a block's alone), and columns of a product of blocks
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 2048
#: rows of orders that are worth a partition of their own
LAID = 50_000
#: counters of the shingles of crowded documents, whatever their number; they only choose which shingles count as rare
COUNTERS, COUNTER_ROW = 1 << 20, 1 << 12
#: bytes of word hashes a task remembers
CACHE = 64 << 20
_ODD = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, HASHES + 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _ODD[HASHES + 3]


class Shingler:
    """Sorted distinct 48-bit hashes of a text's shingles of ASCII-lower-cased words."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.words = Bounded(lambda ws: [xxhash.xxh3_64_digest(w) for w in ws], CACHE)

    def set_of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        w = np.frombuffer(b"".join(self.words.values(words)), "<u8")
        width = min(self.shingle, len(w))
        h = np.zeros(len(w) - width + 1, np.uint64)
        for k in range(width):
            h = (h ^ w[k:len(w) - width + 1 + k]) * _ODD[HASHES + (k & 1)]
            h ^= h >> np.uint64(29)
        h *= _ODD[HASHES + 2]
        if len(w) < self.shingle:
            h ^= np.uint64(len(w) << 40)
        h = np.sort(h >> np.uint64(16))
        return h[np.append(True, h[1:] != h[:-1])]


def pack_set(x: np.ndarray) -> bytes:
    """Low halves, then the upper 16 bits, which are in order and compress away."""
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def chunked(sets: list[np.ndarray]):
    """(first, last, all their elements, where each begins) of runs of sets."""
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 1 << 15):
            size += len(sets[to])
            to += 1
        yield at, to, np.concatenate(sets[at:to]), np.append(0, np.cumsum([len(s) for s in sets[at:to - 1]])).astype(np.int64)
        at = to


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit labels a set: of the least product with each odd multiplier; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint16)
    for at, to, flat, starts in chunked(sets):
        for k in range(HASHES):
            out[at:to, k] = np.minimum.reduceat(flat * _ODD[k], starts) * _MIX >> np.uint64(48)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """A binary value of each row of bytes."""
    rows = np.ascontiguousarray(rows).view(np.uint8)
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(rows)])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bytes from binary values of one width."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def features(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """A table (doc_id, n_shingles, print, signature); print is a 128-bit digest of the set."""
    ship(docs.sparkSession)

    def computed(batches):
        release()
        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            signs = iter([row.tobytes() for row in signatures(some)] if some else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(signs) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "print", "signature"])

    return cut(narrow(docs, id_col, text_col).mapInArrow(computed, "doc_id long, n_shingles long, print binary, signature binary"))


def common(key: np.ndarray) -> np.ndarray:
    """How many labels each row shares with the next one, from the first on; none across two orders."""
    same = key[:-1] == key[1:]
    labels = same[:, 1::2] & same[:, 2::2]
    return np.where(same[:, 0], np.where(labels.all(1), DEPTH, labels.argmin(1)), 0)


def apart(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where two rows are of two components and not both crowded."""
    return (low[i, HASHES:-1] != low[j, HASHES:-1]).any(1) & ((low[i, -1] & low[j, -1]) == 0)


def outwards(key: np.ndarray, low: np.ndarray, fresh: int, near: int, need: float, beside_only: bool = False):
    """Of rows in order: (i, j, next to each other in a chosen order) of candidates with j from ``fresh`` on, and (i, j, prefix) where more would follow."""
    prefix = beside = common(key)
    pairs, ends = [], (np.zeros(0, np.int64),) * 3
    for step in range(1, near + 2):
        if step > 1:
            prefix = np.minimum(prefix[:-1], beside[step - 1:])
        if not (prefix >= LEAST).any():
            break
        i = np.flatnonzero(prefix[max(0, fresh - step):] >= LEAST) + max(0, fresh - step)
        if step > near:
            ends = i, i + step, prefix[i]
        else:
            if beside_only:
                i = i[(key[i, 0] % STEP == 0) & (step == 1)]
            i = i[((low[i, :HASHES] == low[i + step, :HASHES]).sum(1) >= need) & apart(low, i, i + step)]
            pairs.append((i, i + step, (key[i, 0] % STEP == 0) & (step == 1)))
    return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3, ends


FOUND = "kind int, a long, b long, first boolean, depth int, part int, at long, key binary, low binary"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
PAIR, END, ROW, SIZE = range(4)


def _out(kind: int, n: int, **columns) -> pa.RecordBatch:
    every = {"kind": np.full(n, kind, np.int32), **columns}
    return pa.RecordBatch.from_arrays([pa.array(every[c]).cast(t) if c in every else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS)], _NAMES)


def _told(node: np.ndarray, pairs, ends):
    i, j, first = pairs
    if len(i):
        yield _out(PAIR, len(i), a=np.minimum(node[i], node[j]), b=np.maximum(node[i], node[j]), first=first.astype(bool))
    i, j, depth = ends
    if len(i):
        yield _out(END, 2 * len(i), a=np.concatenate([node[i], node[j]]), depth=np.concatenate([depth, depth]))


def neighbours(labels: DataFrame, threshold: float, trees: int = TREES, beside_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b, first) of candidates of the forest over (node, signature, plain); (node, depth) where an order's neighbours end at a longer prefix.

    Orders go by ``signature``, the check of candidates by ``plain``. With ``beside_only`` candidates are those that are
    ``first``; with columns ``component`` and ``crowded`` in ``labels`` those of two components and not both crowded. Both results read a written table. A partition is sorted and passed over once; the rows within reach of its ends are kept for a
    second look, in which those on either side of a border meet.
    """
    spark, near, need, width = labels.sparkSession, NEAR, threshold * HASHES, HASHES + 9
    if "component" not in labels.columns:
        labels = labels.withColumns({"component": F.col("node"), "crowded": F.lit(False)})

    def ordered(batches):
        for batch in batches:
            labels = matrix(batch.column(1), 2 * HASHES).view("<u2")
            component = batch.column(3).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            crowded = np.array(batch.column(4).to_pylist(), np.uint8).reshape(-1, 1)
            low = binary(np.concatenate([(matrix(batch.column(2), 2 * HASHES).view("<u2") & 0xFF).astype(np.uint8), component, crowded], 1))
            for tree in range(trees):
                chosen = labels[:, (tree * (HASHES // trees) + np.arange(DEPTH)) % HASHES].astype(">u2")
                key = np.concatenate([np.full((len(labels), 1), tree, np.uint8), np.ascontiguousarray(chosen).view(np.uint8).reshape(len(labels), -1)], 1)
                yield pa.RecordBatch.from_arrays([binary(key), batch.column(0), low], ["key", "node", "low"])

    def searched(batches):
        part, n = TaskContext.get().partitionId(), 0
        key, node, low = np.zeros((0, 1 + 2 * DEPTH), np.uint8), np.zeros(0, np.int64), np.zeros((0, width), np.uint8)
        for batch in batches:
            if not len(batch):
                continue
            held = len(node)
            key = np.concatenate([key, matrix(batch.column(0), 1 + 2 * DEPTH)])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            low = np.concatenate([low, matrix(batch.column(2), width)])
            yield from _told(node, *outwards(key, low, held, near, need, beside_only))
            if n <= near:
                # the first rows, of which those behind may come in later batches
                to = min(len(node), held + near + 1 - n)
                at = np.arange(n, n + to - held)
                yield _out(ROW, to - held, a=node[held:to], part=np.full(to - held, part), at=at, key=binary(key[held:to]), low=binary(low[held:to]))
            n += len(node) - held
            key, node, low = key[-near - 1:], node[-near - 1:], low[-near - 1:]
        if n:
            # the last rows that were not among the first
            k = min(len(node), max(0, n - near - 1))
            yield _out(ROW, k, a=node[len(node) - k:], part=np.full(k, part), at=np.arange(n - k, n), key=binary(key[len(node) - k:]), low=binary(low[len(node) - k:]))
            yield _out(SIZE, 1, part=[part], at=[n])

    rows = labels.select("node", "signature", "plain", "component", "crowded").mapInArrow(ordered, "key binary, node long, low binary")
    # as many partitions as the session's, fewer for a small table
    n = min(shuffle_partitions(spark), 1 + labels.count() * trees // LAID)
    laid = rows.repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node")
    found = cut(laid.mapInArrow(searched, FOUND))
    # a row a partition
    sizes = sorted((r["part"], r["at"]) for r in found.where(F.col("kind") == SIZE).select("part", "at").collect())
    starts = np.append(0, np.cumsum([n for _, n in sizes])).astype(np.int64)
    begin, borders = {part: s for (part, _), s in zip(sizes, starts.tolist())}, starts[1:-1]

    def handed(batches):
        for batch in batches:
            node, part, at, key, low = batch.columns
            place = np.array([begin[p] for p in part.to_pylist()], np.int64) + at.to_numpy()
            # a row goes to every border within reach
            one, two = np.searchsorted(borders, place - near - 1, "right"), np.searchsorted(borders, place + near + 1, "right")
            times = two - one
            i = pa.array(np.repeat(np.arange(len(place)), times))
            border = np.repeat(one, times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(border), pa.array(place).take(i), node.take(i), key.take(i), low.take(i)], ["border", "place", "node", "key", "low"])

    def met(table):
        table = table.sort_by("place").combine_chunks()
        border, place = table.column("border")[0].as_py(), table.column("place").to_numpy()
        key, low = (matrix(table.column(c).chunk(0), w) for c, w in (("key", 1 + 2 * DEPTH), ("low", width)))
        # rows of the partition behind this border meet those before it
        fresh, node = int(np.searchsorted(place, borders[border])), table.column("node").to_numpy()
        to = int(np.searchsorted(place, borders[border + 1])) if border + 1 < len(borders) else len(place)
        found = [tuple(c[(x[0] < fresh) & (x[1] < to)] for c in x) for x in outwards(key, low, fresh, near, need, beside_only)]
        return pa.Table.from_batches(_told(node, *found), schema=pa.schema(list(zip(_NAMES, _KINDS)))).select(["kind", "a", "b", "first", "depth"])

    edge = found.where(F.col("kind") == ROW).select("a", "part", "at", "key", "low").mapInArrow(handed, "border long, place long, node long, key binary, low binary")
    across = edge.groupBy("border").applyInArrow(met, "kind int, a long, b long, first boolean, depth int")
    every = found.where(F.col("kind") < ROW).select("kind", "a", "b", "first", "depth").union(across)
    return (every.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.max("first").alias("first")),
            every.where(F.col("kind") == END).select(F.col("a").alias("node"), "depth"))


def missed(ends: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, more): by how much the places where neighbours end raise the log of the chance of a miss; either side of an order counts half."""
    s = share[0] / share[1]
    more = [math.log((1 - s ** min(d + 1, DEPTH)) / (1 - s ** LEAST)) / 2 for d in range(DEPTH + 1)]
    return ends.groupBy("node").agg(F.sum(F.element_at(F.array(*map(F.lit, more)), F.col("depth") + 1)).alias("more"))


def compared(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """A table (a, b, likeness, linked) of the pairs by their full sets."""
    some, of = share

    def checked(batches):
        for batch in batches:
            likeness, linked = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common = len(np.intersect1d(unpack_set(x), unpack_set(y), assume_unique=True))
                union = len(x) // 6 + len(y) // 6 - common
                likeness.append(common / union)
                linked.append(of * common >= some * union)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(likeness, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "likeness", "linked"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long, likeness double, linked boolean"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after a few more links: only the components these join are looked at."""
    ends = links.select("a").union(links.select("b")).distinct().toDF("node")
    every = cut(found.union(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))))
    over = components(links.join(every.toDF("a", "x"), "a").join(every.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    return cut(every.join(over.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def popularity(sets: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each counter: 4 MB, whatever the data."""
    def counted(batches):
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                np.add.at(n, (unpack_set(raw) % np.uint64(COUNTERS)).astype(np.int64), 1)
        rows = n.reshape(-1, COUNTER_ROW)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), binary(rows[some])], ["counter", "n"])

    def summed(batches):
        # a task has the rows of some counters, one after the other: it holds one sum at a time
        now, total = None, None
        for batch in batches:
            for counter, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if counter != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), binary(np.minimum(total, 0xFFFFFFFF).astype("<u4")[None])], ["counter", "n"])
                    now, total = counter, np.zeros(COUNTER_ROW, np.int64)
                total += np.frombuffer(raw, np.int64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), binary(np.minimum(total, 0xFFFFFFFF).astype("<u4")[None])], ["counter", "n"])

    rows = sets.select("shingles").mapInArrow(counted, "counter long, n binary").repartition("counter").sortWithinPartitions("counter")
    out = np.zeros((COUNTERS // COUNTER_ROW, COUNTER_ROW), np.uint32)
    for r in rows.mapInArrow(summed, "counter long, n binary").collect():
        out[r["counter"]] = np.frombuffer(r["n"], "<u4")
    return out.ravel()


def rarest(tokens: np.ndarray, held: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Of a set, in order of rarity, so many that a set above the threshold shares one of them, and it is one of that set's."""
    n = len(tokens) - -(-share[0] * len(tokens) // share[1]) + 1
    return tokens[np.lexsort((tokens, held[(tokens % np.uint64(COUNTERS)).astype(np.int64)]))[:n]]


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of ``COLUMNS`` elements at a time."""
    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (x, i), (y, j) = flat(one), flat(two)
    every = np.intersect1d(x, y)
    out = np.zeros((len(one), len(two)), np.float64)

    def held(tokens, rows):
        at = np.searchsorted(every, tokens)
        some = np.flatnonzero((at < len(every)) & (every[np.minimum(at, len(every) - 1)] == tokens))
        some = some[np.argsort(at[some], kind="stable")]
        return at[some], rows[some]

    if len(every):
        (x, i), (y, j) = held(x, i), held(y, j)
        for low in range(0, len(every), COLUMNS):
            sides = []
            for at, rows, n in ((x, i, len(one)), (y, j, len(two))):
                a, b = np.searchsorted(at, (low, low + COLUMNS))
                side = np.zeros((n, min(COLUMNS, len(every) - low)), np.float32)
                side[rows[a:b], at[a:b] - low] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
    return out


def crowded_links(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """A table (a, b) of the components joined by links among (node, shingles, component): none is left out.

    A hot place is dealt in blocks, and any two of its blocks meet in a group of their own.
    """
    spark, (some, of) = sets.sparkSession, share
    shared = spark.sparkContext.broadcast(popularity(sets))

    def listed(batches):
        for batch in batches:
            tokens = [rarest(unpack_set(x), shared.value, share) for x in batch.column(1).to_pylist()]
            i = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
            flat = np.concatenate([np.zeros(0, np.uint64), *tokens]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(i), batch.column(2).take(i)], ["token", "node", "component"])

    rare = sets.select("node", "shingles", "component").mapInArrow(listed, "token long, node long, component long")
    held = rare.groupBy("token").agg(F.min("node").alias("least"), F.min("component").alias("one"), F.max("component").alias("two"))
    # documents that a rare shingle connects, if they are of two components, are of one place
    edges = cut(rare.join(held.where("one < two"), "token").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    if edges.isEmpty():
        return edges
    placed = cut(sets.join(components(edges).toDF("node", "place"), "node").select("place", "node", "component", "shingles"))
    size = F.sum(F.octet_length("shingles") / 6)
    places = placed.groupBy("place").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(size / BLOCK_SHINGLES)).alias("blocks"))
    dealt = placed.join(places, "place").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "shingles")

    def compared(table):
        i, j, block = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("block").to_numpy()
        sets, component = [unpack_set(x) for x in table.column("shingles").to_pylist()], table.column("component").to_numpy()
        one, two = (np.flatnonzero(block == k) for k in (i, j))
        a = b = np.zeros(0, np.int64)
        if len(one) and len(two):
            both = overlaps([sets[k] for k in one], [sets[k] for k in two])
            n = np.array([len(s) for s in sets])
            x, y = np.nonzero(of * both >= some * (n[one][:, None] + n[two][None] - both))
            a, b = component[one[x]], component[two[y]]
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # rows are spread by the key before the groups; groups of one block pair each are what a task holds
    return cut(met.groupBy("place", "i", "j").applyInArrow(compared, "a long, b long").distinct())


def groups(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    table = features(docs, shingle, id_col, text_col)
    usable = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = cut(usable.groupBy("print").agg(F.min("doc_id").alias("node"), F.min_by("signature", "doc_id").alias("signature")))
    threshold = share[0] / share[1] - SLACK
    sure = TREES * math.log(1 - (share[0] / share[1]) ** LEAST)
    classes = equal.select("node", "signature").withColumn("plain", F.col("signature"))
    pairs, ends = neighbours(classes, threshold, beside_only=True)
    first = cut(pairs.select("a", "b"))
    crowded = cut(missed(ends, share).where(F.col("more") + sure > math.log(MISS)).select("node"))

    def listed(batches):
        shingler = Shingler(shingle)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack_set(shingler.set_of(t)) for t in batch.column(1).to_pylist()], pa.binary())], ["node", "shingles"])

    def sets_of(nodes):
        texts = narrow(docs, id_col, text_col).withColumnRenamed("doc_id", "node").join(nodes.distinct().hint("shuffle_hash"), "node", "left_semi")
        return cut(texts.mapInArrow(listed, "node long, shingles binary").distinct())

    sets = sets_of(first.select("a").union(first.select("b")).union(crowded).toDF("node"))
    found = cut(components(compared(first, sets, share).where("linked").select("a", "b")))
    marked = classes.join(found, "node", "left").join(crowded.withColumn("crowded", F.lit(True)), "node", "left").select(
        "node", "signature", "plain", F.coalesce("component", "node").alias("component"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
    rest = cut(neighbours(marked, threshold)[0].select("a", "b"))
    more = rest.select("a").union(rest.select("b")).toDF("node").join(sets, "node", "left_anti")
    linked = compared(rest, sets.union(sets_of(more)), share).where("linked").select("a", "b")
    found = found if linked.isEmpty() else merged(found, linked)
    if not crowded.isEmpty():
        held = cut(sets.join(crowded, "node").join(found, "node", "left").select("node", "shingles", F.coalesce("component", "node").alias("component")))
        links = crowded_links(held, share)
        found = found if links.isEmpty() else merged(found, links)
    to_class = equal.select("print", "node")
    rows = table.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    rows = rows.join(to_class, "print", "left").join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one row a group, with all their columns: the smallest id, a missing one last.

    Rows are told apart by a number of their own, so one with a repeated or missing id is judged by its own text.
    """
    table = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")))
    keyed = table.select("key", F.col(f"row.`{text_col}`").alias("text"))
    named = table.select("key", F.col(f"row.`{id_col}`").cast("long").alias("id"))
    found = groups(keyed, shingle, share, "key").select(F.col("doc_id").alias("key"), "component_id").join(named, "key")
    stay = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")).select("first.key")
    return table.join(stay.hint("shuffle_hash"), "key", "left_semi").select("row.*")


@query("op5_near_dedup", r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM t),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, n_shingles, min(m) AS component_id, doc_id = min(m) AS kept FROM n JOIN r USING (doc_id) GROUP BY doc_id, n_shingles""")
def op5(spark, sf_dir):
    return groups(documents(spark, sf_dir))
