"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in id order, form blocks of a fixed number of rows. With weight w, block i (from 0) is released
at slot floor(i / w) and due at slot ceil((i + 1) / w); each slot takes the released block that is due first. So at any
slot every source has received its weighted share to within less than one block.

Weights are integers, so the schedule repeats after as many slots as their sum. The driver computes that one period
(it depends on the weights alone); where a document goes is arithmetic on its rank. When a source has no block left,
the others go on in a new phase with their weights, so every row is placed.

Cases: null sources are one source; a source without a given weight has weight 1, so none is dropped; the last block of
a source may be short; rows that repeat an id are ordered by their text; nulls come first; an empty table gives an
empty result; further columns, whatever their names, come through.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import documents, in_order
from .registry import query

#: rows of a block
BLOCK_ROWS = 16
#: sum of the default weights, about; also the longest period
PERIOD = 1000


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period, earliest deadline first among released blocks."""
    total = sum(weights.values())
    released: dict[int, list[tuple[int, str]]] = {}
    for name, w in weights.items():
        for i in range(w):
            released.setdefault(i * total // w, []).append((-(-(i + 1) * total // w), name))
    ready: list[tuple[int, str]] = []
    slots: dict[str, list[int]] = {name: [] for name in weights}
    for t in range(total):
        for block in released.get(t, ()):
            heapq.heappush(ready, block)
        slots[heapq.heappop(ready)[1]].append(t)
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> dict[str, list[tuple[int, int, int, list[int]]]]:
    """For each source (first block, slot at which the phase starts, length of its period, slots in it), phase by phase."""
    left = {name: n for name, n in blocks.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    plan: dict[str, list] = {name: [] for name in left}
    start = 0
    while left:
        g = math.gcd(*(weights[name] for name in left))
        active = {name: weights[name] // g for name in left}
        length, slots = sum(active.values()), period(active)
        for name in left:
            plan[name].append((taken[name], start, length, slots[name]))
        # the phase ends with the slot in which some source places its last block
        end = min(length * ((n - 1) // active[name]) + slots[name][(n - 1) % active[name]] for name, n in left.items()) + 1
        for name in list(left):
            n = active[name] * (end // length) + sum(s < end % length for s in slots[name])
            taken[name] += n
            left[name] -= n
            if not left[name]:
                del left[name]
        start += end
    return plan


def softened(rows: dict[str, int]) -> dict[str, int]:
    """Default weights: in proportion to the square root of a source's rows, so that small sources count more."""
    whole = sum(math.sqrt(n) for n in rows.values())
    return {name: max(1, round(PERIOD * math.sqrt(n) / whole)) for name, n in rows.items()}


def scheduled(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(row, source, source_rank, block, slot): each row of ``docs`` as a struct, its place in its source and its slot.

    Ranks come from parts of the whole (source, id) order plus the number of a source's rows in earlier parts: a source
    with a third of all rows spreads over a third of the parts. The driver sees one count a source and the weights.
    """
    spark = docs.sparkSession
    # a name for each source, the null one included
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    ties = [F.xxhash64(F.col(text_col)).alias("tie")] if text_col in docs.columns else []
    keyed = docs.select(F.struct("*").alias("row"), name.alias("name"), F.col(id_col).alias("id"), *ties)
    placed = in_order(keyed, "name", "id", *(["tie"] if ties else []))
    parts = placed.groupBy("name", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("name").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("name", "slice", (before - F.col("first")).alias("shift"))
    rows = {r["name"]: r["n"] for r in placed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = {f"={k}" if k is not None else "": v for k, v in weights.items()} if weights else softened(rows)
    plan = phases({k: given.get(k, 1) for k in rows}, {k: -(-n // block_rows) for k, n in rows.items()})
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("plan", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("slots", T.ArrayType(T.LongType()))])))])
    table = spark.createDataFrame(list(plan.items()), schema)
    # one row a (source, part) and one a source: at most parts + sources, and sources + phases x weights
    ranked = placed.join(F.broadcast(parts), ["name", "slice"]).join(F.broadcast(table), "name").select(
        "row", (F.col("at") + F.col("shift")).alias("source_rank"), "plan")
    ranked = ranked.withColumn("block", F.floor(F.col("source_rank") / block_rows))
    phase = F.element_at(F.filter("plan", lambda p: p["first"] <= F.col("block")), -1)
    ranked = ranked.withColumn("phase", phase).withColumn("nth", F.col("block") - F.col("phase.first"))
    width = F.size("phase.slots")
    slot = F.col("phase.start") + F.floor(F.col("nth") / width) * F.col("phase.length") + F.get("phase.slots", (F.col("nth") % width).cast("int"))
    return ranked.select("row", F.col(f"row.`{source_col}`").alias("source"), "source_rank", "block", slot.alias("slot"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, **columns: str) -> DataFrame:
    """All rows and columns of ``docs`` in mixed order: written as files, the files in order hold the mixture."""
    return scheduled(docs, weights, block_rows, **columns).orderBy("slot", "source_rank").select("row.*")


@query("op1_mixing")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return scheduled(docs).select("row.doc_id", "source", "source_rank", "block", "slot").orderBy("slot", "source_rank")
