"""Token files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

Ids are replaced by their rank in frequency over all documents, so frequent ones take one byte. Four ranks share a
control byte (two bits each: bytes less one); all control bytes of a record come first, then the data bytes. A reader
looks control bytes up in a table of 256 x 4 lengths and gathers the values with numpy, without a loop.

Files hold documents in ascending id order. Records are written and read by Spark's own file sources, so any store
Spark reaches will do, and a task that runs again replaces its own files. Layout (little-endian):

    record   magic "SVB1" | bucket u32 | docs u32 | ids u64 | start u64 | bytes of data u64
             doc_id i64[docs] | n_tokens u32[docs] | control u8[ceil(ids / 4)] | data u8[] | newline
    ranks/   id u16[] in order of rank | newline

Cases: a null or empty text has the end id alone; null ids come first and are stored as the smallest i64; rows that
repeat an id keep rows of their own, in the order of their ids' bytes; an empty table writes no record.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import cut, scratch

from .coding import coder, seldom_collected
from .common import documents, narrow, ship
from .registry import query

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: ids a file holds, about
FILE_IDS = 2_000_000
HEADER = "<4sIIQQQ"
NULL_ID = -(1 << 63)
#: bytes of each of the four values of a control byte
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n_bytes = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n_bytes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    first = np.cumsum(n_bytes, dtype=np.int64) - n_bytes
    data = np.empty(int(first[-1]) + int(n_bytes[-1]) if len(v) else 0, np.uint8)
    data[first] = v.astype(np.uint8)
    for k in (1, 2, 3):
        longer = np.flatnonzero(n_bytes > k)
        if not len(longer):
            break
        data[first[longer] + k] = (v[longer] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values behind control and data bytes."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    first = ends - lengths
    out = data[first].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= data[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table (doc_id, n_tokens, ids): every text's ids and the end id, as unsigned 16-bit integers."""
    ship(docs.sparkSession)
    end = np.array([END_ID], "<u2")

    def encode(batches):
        code = coder(vocabulary)
        for batch in batches:
            with seldom_collected():
                ids = [np.concatenate([code.ids(t), end]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = narrow(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    return cut(rows.mapInArrow(encode, "doc_id long, n_tokens int, ids binary"))


def _texts(batches, column: int):
    for batch in batches:
        yield batch, [np.frombuffer(x, "<u2") for x in batch.column(column).to_pylist()]


def write(table: DataFrame, path: str, file_ids: int = FILE_IDS) -> None:
    """Write an ``encoded`` table as token files under ``path``."""
    spark = table.sparkSession
    total = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    n_files = max(1, -(-total // file_ids))
    cuts = [i / n_files for i in range(1, n_files)]
    quantiles = table.agg(F.percentile_approx("doc_id", F.lit(cuts) if cuts else F.array(F.lit(0.5)), F.lit(10_000))).first()[0] or []
    bounds = np.unique(np.array(quantiles if cuts else [], np.int64))

    def counted(batches):
        ids, files = np.zeros(1 << 16, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch, texts in _texts(batches, 1):
            ids += np.bincount(np.concatenate(texts), minlength=1 << 16)
            at = np.searchsorted(bounds, batch.column(0).to_numpy(), "right")
            np.add.at(files, at, [len(x) for x in texts])
        for kind, n in ((0, ids), (1, files)):
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), kind)), pa.array(seen), pa.array(n[seen])], ["kind", "key", "n"])

    # one row an id of the vocabulary and one a file
    sums = table.select("doc_id", "ids").mapInArrow(counted, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([k for _, k in sorted((-r["n"], r["key"]) for r in sums if r["kind"] == 0)], "<u2")
    ranks = np.zeros(1 << 16, "<u2")
    ranks[by_rank] = np.arange(len(by_rank))
    per_file = np.zeros(len(bounds) + 1, np.int64)
    for r in sums:
        if r["kind"] == 1:
            per_file[r["key"]] = r["n"]
    starts = np.concatenate([[0], np.cumsum(per_file)]).tolist()

    def packets(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch, texts in _texts(batches, 1):
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(bounds, ids, "right")
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order])) + 1
            buckets, out = [], []
            for rows in np.split(order, edges) if len(order) else []:
                flat = ranks[np.concatenate([texts[i] for i in rows])]
                sizes = np.array([len(texts[i]) for i in rows], "<u4")
                buckets.append(int(at[rows[0]]))
                out.append(squeeze.compress(struct.pack("<I", len(rows)) + ids[rows].astype("<i8").tobytes() + sizes.tobytes() + flat.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(out, pa.binary())], ["bucket", "packet"])

    def records(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for bucket, packet in zip(*(c.to_pylist() for c in batch.columns)):
                raw = zstandard.ZstdDecompressor().decompress(packet)
                n = struct.unpack_from("<I", raw)[0]
                sizes = np.frombuffer(raw, "<u4", n, 4 + 8 * n)
                flat = np.frombuffer(raw, "<u2", -1, 4 + 12 * n)
                found.setdefault(bucket, []).extend(zip(np.frombuffer(raw, "<i8", n, 4).tolist(), np.split(flat, np.cumsum(sizes)[:-1].astype(np.int64))))
        for bucket in sorted(found):
            docs = sorted(found[bucket], key=lambda d: (d[0], d[1].tobytes()))
            values = np.concatenate([x for _, x in docs])
            control, data = pack(values)
            head = struct.pack(HEADER, b"SVB1", bucket, len(docs), len(values), starts[bucket], len(data))
            body = np.array([d for d, _ in docs], "<i8").tobytes() + np.array([len(x) for _, x in docs], "<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([head + body + control + data], pa.binary())], ["record"])

    # a partition a file, in order; Spark's text writer puts the bytes down as they are, with a newline behind
    dealt = table.select("doc_id", "ids").mapInArrow(packets, "bucket int, packet binary").repartitionById(len(starts) - 1, "bucket")
    dealt.mapInArrow(records, "record binary").select(F.col("record").cast("string")).write.text(f"{path}/data")
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ranks binary").select(F.col("ranks").cast("string")).coalesce(1).write.text(f"{path}/ranks")


def read_records(content: bytes):
    """(start, doc_ids, sizes, ranks) of every record of a file."""
    at = 0
    while at < len(content):
        magic, _, n_docs, n_ids, start, n_data = struct.unpack_from(HEADER, content, at)
        assert magic == b"SVB1", "not a token file"
        at += struct.calcsize(HEADER)
        doc_ids = np.frombuffer(content, "<i8", n_docs, at)
        sizes = np.frombuffer(content, "<u4", n_docs, at + 8 * n_docs)
        at += 12 * n_docs
        n_control = -(-n_ids // 4)
        control = np.frombuffer(content, np.uint8, n_control, at)
        data = np.frombuffer(content, np.uint8, n_data, at + n_control)
        at += n_control + n_data + 1
        yield start, doc_ids, sizes, unpack(control, data, n_ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the token files under ``path``; ids as unsigned 32-bit integers."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    # one small file, as long as the vocabulary
    ranks = [r["content"] for r in files.load(f"{path}/ranks").select("content").collect() if r["content"]]
    by_rank = np.frombuffer(ranks[0][:-1] if ranks else b"", "<u2")

    def decode(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for start, doc_ids, sizes, values in read_records(content):
                    raw = memoryview(by_rank[values].astype("<u4").tobytes())
                    ends = np.cumsum(sizes, dtype=np.int64)
                    first = ends - sizes
                    parts = [raw[4 * i:4 * j] for i, j in zip(first.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(first + start, pa.int64()), pa.array(sizes.astype(np.int64)),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.load(f"{path}/data").select("content").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


@query("op2_token_files")
def op2(spark, sf_dir):
    path = scratch(spark, "tokens")
    write(encoded(documents(spark, sf_dir)), path)
    return read(spark, path).drop("ids")
