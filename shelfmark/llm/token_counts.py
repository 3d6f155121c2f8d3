"""Token counts with a two-tier look-up on the map side: a broadcast table of frequent pre-tokens, worker caches behind it.

A first pass counts pre-tokens inside each task and sends only a task's most frequent ones on; the most frequent over
all tasks are encoded once and broadcast as a compact table (one text and one array of lengths). The second pass adds
up lengths; pre-tokens the table lacks are encoded by the library and remembered by the worker. Neither pass shuffles
pre-tokens. The table only saves time: whatever it holds, counts are the library's.

A text is cut before every run of spaces that follows another character. No piece of the vocabulary has a space mark
behind another character, so no piece spans a cut; the class checks that when it loads the file.

Cases: a null text is empty and has no token; white space other than spaces belongs to its pre-token; a text with the
mark character itself is given to the library whole; ids may repeat or be null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coding import Recent
from .common import documents, narrow, ship
from .registry import query

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: entries of the broadcast table, of a task's list, and of a task's counter before it drops its rarest
TABLE, TASK_LIST, COUNTED = 50_000, 8_192, 400_000
#: pre-tokens a worker remembers in one generation
CACHE = 400_000
#: bytes of the longest pre-token in the broadcast table: with TABLE entries it has at most 3.3 MB of text
WORD_BYTES = 64
MARK = "▁"
PRETOKEN = re.compile(" *[^ ]+| +")


class PieceCounter:
    """Number of pieces a text has, by the sentencepiece library."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        assert not any(MARK in p.lstrip(MARK) for p in pieces), "a piece holds a space mark behind another character"
        self.words = Recent(self.lengths, cache)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def use(self, table: dict[str, int]) -> None:
        self.words.table = table

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            return self.lengths([text])[0]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(self.words.values(text.split(" ")))
        # the library puts one space before a text: a run of n spaces is asked for as n - 1; at the start it has n + 1
        first, *runs = PRETOKEN.findall(text)
        ends = bool(runs) and not runs[-1].strip(" ")
        last = runs.pop() if ends else ""
        asked = [x[1:] for x in runs] + ([last[1:]] if len(last) > 1 else [])
        return sum(self.words.values([first, *asked])) + (len(last) == 1)


_COUNTERS: dict[str, PieceCounter] = {}


def counter(name: str) -> PieceCounter:
    if name not in _COUNTERS:
        import os

        import public_tokenizers

        _COUNTERS[name] = PieceCounter(name if os.path.sep in name else public_tokenizers.path(name))
    return _COUNTERS[name]


def frequent(docs: DataFrame, text_col: str = "text", table: int = TABLE, task_list: int = TASK_LIST) -> list[str]:
    """The most frequent pre-tokens over all documents, as far as tasks list them; those beyond ``WORD_BYTES`` stay out."""

    def listed(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(w for w in text.split(" ") if len(w) <= WORD_BYTES)
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(w, n) for w, n in seen.most_common(task_list) if w and n > 1 and len(w.encode()) <= WORD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lists = texts.mapInArrow(listed, "word string, n long")
    top = lists.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table)
    return [r["word"] for r in top.select("word").collect()]


def count(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    ship(spark)
    words = [w for w in frequent(docs, text_col, table) if MARK not in w]
    lengths = np.array(counter(model).lengths(words), "<u2")
    shared = spark.sparkContext.broadcast((" ".join(words), lengths.tobytes()))

    def counted(batches):
        pieces = counter(model)
        names, packed = shared.value
        pieces.use(dict(zip(names.split(" "), np.frombuffer(packed, "<u2").tolist())) if names else {})
        for batch in batches:
            n = [pieces.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = narrow(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


@query("op7_token_counts")
def op7(spark, sf_dir):
    return count(documents(spark, sf_dir))
