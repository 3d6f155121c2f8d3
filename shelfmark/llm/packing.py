"""Packing into token sequences as a cutting-stock problem solved by column generation.

Every document is cut into full sequences and a rest, and a rest beyond half a sequence into a half and what is left
(pieces of up to a half combine almost without padding). Pieces are counted by length class (lengths rounded up to a
multiple of ``STEP``), and the driver plans from that histogram alone: a linear program over patterns (which classes
share a sequence) is grown column by column, a knapsack dynamic program over its dual prices finding each new pattern.
The program's pattern counts are rounded down, and what demand remains is filled greedily. Pattern counts then assign
sequences by arithmetic: the k-th piece of a class, in rank over the whole table, has a known sequence and place.

With an ``order`` of the documents, ranks follow it, every pattern is spread over the whole order in ``CHUNKS`` parts, and
sequences are numbered by the first piece they hold: sequences in order then show the documents in about that order.

Cases: a null or empty text has the end id alone; ids may repeat or be null; an empty table gives an empty result.
The last rank of a class may leave a pattern short; that sequence is padded more.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from shelfmark.session import cut

from .coding import coder, seldom_collected
from .common import SLICE_BITS, documents, in_order, narrow, ship
from .registry import query

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
LENGTH = 1024
#: width of a length class, in tokens: what rounding up can waste on a piece, less one
STEP = 4
#: parts of an order that every pattern is spread over
CHUNKS = 32


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest price that fits (unbounded knapsack; class i takes i + 1 units)."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        gain = value[room - 1::-1][:len(prices)] + prices[:room]
        best = int(np.argmax(gain))
        value[room], taken[room] = max((gain[best], best), (value[room - 1], -1))
    counts, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= taken[room] + 1
    return float(value[capacity]), counts


def plan_patterns(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) so that all demand is met; ``demand[i]`` pieces of i + 1 units, capacity as many units as classes."""
    capacity = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    units = used + 1
    d = demand[used].astype(float)
    basis = np.diag((capacity // units).astype(float))
    idle = 0
    objective = np.inf
    # revised simplex: a column enters while the knapsack finds a pattern worth more than one sequence
    while idle < 50:
        x = np.linalg.solve(basis, d)
        duals = np.linalg.solve(basis.T, np.ones(len(used)))
        prices = np.zeros(capacity)
        prices[used] = duals
        worth, column = best_pattern(prices, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column[used].astype(float))
        ratios = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = column[used]
        now = float(x.sum())
        idle = 0 if now < objective - 1e-6 * max(1.0, now) else idle + 1
        objective = min(objective, now)
    times = np.floor(np.maximum(np.linalg.solve(basis, d), 0) + 1e-9).astype(np.int64)
    left = demand.astype(np.int64).copy()
    plan = []
    for j in np.flatnonzero(times):
        pattern = np.zeros(capacity, np.int64)
        pattern[used] = np.rint(basis[:, j]).astype(np.int64)
        # a rounded count never exceeds what is left of any of its classes
        n = int(min([times[j], *(left[pattern > 0] // pattern[pattern > 0])]))
        if n:
            plan.append((pattern, n))
            left -= n * pattern
    while left.any():
        pattern, room = np.zeros(capacity, np.int64), capacity
        for i in np.flatnonzero(left)[::-1]:
            pattern[i] = min(left[i], room // (i + 1))
            room -= pattern[i] * (i + 1)
        n = int(np.min(left[pattern > 0] // pattern[pattern > 0]))
        plan.append((pattern, n))
        left -= n * pattern
    return plan


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, step: int = STEP, id_col: str = "doc_id", text_col: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """A table of pieces, with the class of each and its number within (task, class); tasks and numbers follow ``order`` if given."""
    ship(docs.sparkSession)

    def cut_up(batches):
        code, task, end = coder(vocabulary), TaskContext.get().partitionId(), np.array([END_ID], "<u4")
        counts = np.zeros(-(-length // step), np.int64)
        for batch in batches:
            rows: list[tuple] = []
            with seldom_collected():
                found = [code.ids(text) for text in batch.column(1).to_pylist()]
            for doc_id, ids, *place in zip(batch.column(0).to_pylist(), found, *(c.to_pylist() for c in batch.columns[2:])):
                ids = np.concatenate([ids.astype("<u4"), end])
                raw = memoryview(ids.tobytes())
                full, half = len(ids) // length * length, length // 2
                edges = [*range(0, full, length), full, *([full + half] if len(ids) > full + half else []), len(ids)]
                for at, to in zip(edges, edges[1:]):
                    n = to - at
                    if not n:
                        continue
                    kind = -(-n // step) - 1
                    rows.append((doc_id, at, n, zlib.crc32(raw[4 * at:4 * (at + n)]), len(ids), kind, task, int(counts[kind]), *place))
                    counts[kind] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "task", "nth", *places]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    places = [f"place{i}" for i in range(len(order))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).cast("long").alias(p) for c, p in zip(order, places)])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "task", "nth", *places]
    table = rows.mapInArrow(cut_up, ", ".join(f"{c} long" for c in names))
    if not order:
        return cut(table)
    # the whole order lies in slices, which take the place of tasks
    laid = in_order(table.drop("task", "nth"), *places, "start").withColumn("position", F.col("slice") * (1 << SLICE_BITS) + F.col("at"))
    nth = F.row_number().over(W.partitionBy("kind", "slice").orderBy("at")).cast("long") - 1
    return cut(laid.withColumn("nth", nth).select(*names[:6], F.col("slice").alias("task"), "nth", "position"))


def assign(table: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """Sequence and offset of every row of a ``pieces`` table."""
    counts = table.groupBy("kind", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("kind").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("kind", "task", before.alias("shift"))
    histogram = np.zeros(-(-length // step), np.int64)
    for r in table.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["kind"]] = r["n"]
    # for each class: from which rank on a pattern takes its pieces, how many a sequence, and the pattern's first sequence
    taken = np.zeros(len(histogram), np.int64)
    base, lists = 0, {}
    patterns, ordered = plan_patterns(histogram), "position" in table.columns
    chunks = CHUNKS if ordered else 1
    for chunk in range(chunks):
        for pattern, times in patterns:
            n = times * (chunk + 1) // chunks - times * chunk // chunks
            for i in np.flatnonzero(pattern) if n else ():
                lists.setdefault(int(i), []).append((int(taken[i]), int(pattern[i]), base))
                taken[i] += n * pattern[i]
            base += n
    schema = T.StructType([T.StructField("kind", T.LongType()), T.StructField("plan", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("each", T.LongType()), T.StructField("base", T.LongType())])))])
    plan = table.sparkSession.createDataFrame(list(lists.items()), schema)
    # the plan has a row a class and at most chunks x patterns entries in it, whatever the number of documents
    ranked = table.join(shifts, ["kind", "task"]).withColumn("rank", F.col("nth") + F.col("shift")).join(F.broadcast(plan), "kind")
    mine = ranked.withColumn("use", F.element_at(F.filter("plan", lambda p: p["first"] <= F.col("rank")), -1))
    nth = F.col("rank") - F.col("use.first")
    placed = mine.withColumn("sequence_id", F.col("use.base") + F.floor(nth / F.col("use.each"))).withColumn("place", nth % F.col("use.each"))
    if ordered:
        placed = renumbered(placed)
    inside = W.partitionBy("sequence_id").orderBy(F.desc("kind"), "place").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def renumbered(placed: DataFrame) -> DataFrame:
    """Sequences numbered by the first position they hold."""
    table = in_order(placed.groupBy("sequence_id").agg(F.min("position").alias("first")), "first")
    # a row a slice
    sizes = sorted((r["slice"], r["n"]) for r in table.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *itertools.accumulate(n for _, n in sizes)]
    shifts = [(part, start) for (part, _), start in zip(sizes, before)]
    shift = F.broadcast(placed.sparkSession.createDataFrame(shifts, "slice long, shift long"))
    numbers = table.join(shift, "slice").select("sequence_id", (F.col("at") + F.col("shift")).alias("number"))
    return placed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("number"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, step: int = STEP, **columns) -> DataFrame:
    return assign(pieces(docs, vocabulary, length, step, **columns), length, step)


@query("op10_packing")
def op10(spark, sf_dir):
    return pack(documents(spark, sf_dir))
