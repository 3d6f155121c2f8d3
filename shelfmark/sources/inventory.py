"""Inventory sources: loose files, archive members and their hashes."""

from __future__ import annotations

import itertools
import os
import re
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import tables as T
from shelfmark.functions.checksums import joined
from shelfmark.plans.writer import BLOCK, local_path, opened, swap_block
from shelfmark.session import cut, scratch, ship, spread

MEMBERS = (
    "collection string, file_name string, path string, member_pos int, member_name string, size bigint, "
    "compress_size bigint, crc string, error string"
)


def collection_of(path: Column) -> Column:
    """Name of the directory a file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _named(spark: SparkSession, directories: tuple[str, ...]) -> tuple[list[str], bool]:
    """The folders and files that the paths name, and whether all of them lie where every executor has them mounted."""
    sc, found, mounted = spark.sparkContext, [], True
    for directory in directories:
        path = sc._jvm.org.apache.hadoop.fs.Path(directory)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        named = fs.globStatus(path)
        if not named:  # what is missing Spark's own reader says
            return [], False
        found += [x.toString() for x in sc._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(named)]
        mounted = mounted and fs.getUri().getScheme() == "file"
    return found, mounted


def _left_out(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


#: on file systems that only Spark opens: folders listed first, and about how many files the driver names at a time from then on
FOLDERS, NAMED = 40, 50_000
#: bytes up to which a file from there goes into a table with others
SMALL = 1 << 20
#: while Spark lists: where blocks lie is not asked for, file by file, and no listing is kept behind the table made from it
_LISTING = {"spark.sql.sources.ignoreDataLocality": "true", "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


def _opened_by_spark(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files in folders, and files, as Spark's reader gives them; its driver names them all as long as this is in use."""
    before = {k: spark.conf.get(k, None) for k in _LISTING}
    try:
        for k, v in _LISTING.items():
            spark.conf.set(k, v)
        return spark.read.format("binaryFile").option("recursiveFileLookup", False).load(paths)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _as_named(path: str) -> str:
    """A pattern that only this path matches."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _gathered(spark: SparkSession, roots: list[str], content: bool) -> DataFrame:
    """(path, length), and content, of what Spark opens, put into a table a group of folders at a time.

    The driver names the files of one group, and with ``content`` those beyond ``SMALL``, which are read where they are used.
    """
    roots = list(map(_as_named, roots))
    columns = ["path", "length", *["content"] * content]
    if content and len(roots) <= FOLDERS:
        return _opened_by_spark(spark, roots).select(columns)
    table, size, large, done, n, step = scratch(spark, "files"), F.col("_metadata.file_size"), [], 0, 0, FOLDERS
    while done < len(roots):
        files = _opened_by_spark(spark, roots[done:done + step])
        done += step
        if content:
            large += [r["path"] for r in files.where(size > SMALL).select("path").collect()]
            files = files.where(size <= SMALL)
        seen = Observation()
        files = files.select(columns)
        files.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(table)
        n += seen.get["n"]
        step = max(1, min(4 * step, NAMED, NAMED * done // (n + len(large) + 1)))
    every = spark.read.schema(files.schema).parquet(table)
    return every.union(_opened_by_spark(spark, list(map(_as_named, large))).select(columns)) if large else every


def _listed(spark: SparkSession, directories: tuple[str, ...], content: bool = False) -> DataFrame:
    """(path, size), and, if asked for, content on file systems that only Spark opens."""
    roots, mounted = _named(spark, directories)
    if not mounted:
        files = _gathered(spark, roots, content) if roots else _opened_by_spark(spark, list(directories))
        return files.withColumnRenamed("length", "size")
    roots = list(dict.fromkeys(roots))

    def files_in(root: str):
        local = local_path(root)
        if os.path.isfile(local):
            yield root, os.path.getsize(local)
            return
        with os.scandir(local) as entries:
            for e in entries:
                if not _left_out(e.name) and e.is_file():
                    yield f"{root.rstrip('/')}/{os.fsencode(e.name).decode(errors='replace')}", e.stat().st_size

    def run(batches):
        for batch in batches:
            found = itertools.chain.from_iterable(map(files_in, batch.column(0).to_pylist()))
            while rows := list(itertools.islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64()))], ["path", "size"])

    ship(spark)
    folders = spread(spark.createDataFrame([(r,) for r in roots], "folder string"), "folder")
    return cut(folders.mapInArrow(run, "path string, size bigint"))


def list_files(spark: SparkSession, *directories: str) -> DataFrame:
    """Files directly in the given directories, with size. Content is not read.

    Mounted folders are listed by tasks, a folder a task, into a table; the driver only names the folders. On other file
    systems Spark lists a group of folders at a time, whose files its driver names. Names that begin with ``_`` or ``.`` are left out.
    """
    return _listed(spark, directories).select(
        "path", collection_of(F.col("path")).alias("collection"),
        N.base_name(F.col("path")).alias("file_name"), "size")


def with_contents(files: DataFrame) -> DataFrame:
    """Listed files (path, collection, file_name) on mounted folders, each with its content; spread before anything is read."""
    names = ["path", "collection", "file_name"]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                with open(local_path(row[0]), "rb") as content:
                    rows.append((*row, content.read()))
                held += len(rows[-1][-1])
                if held >= BLOCK:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.string()] * 3, pa.binary()])], [*names, "content"])

    ship(files.sparkSession)
    return spread(files.select(*names), "path").mapInArrow(run, "path string, collection string, file_name string, content binary")


def read_contents(spark: SparkSession, *directories: str) -> DataFrame:
    """Files directly in the given directories, each with its content, from any file system Spark reads.

    A row holds a whole file (2 GB at most); it is read where it is used and goes into no shuffle, except that from many
    folders of a file system that only Spark opens files of up to ``SMALL`` bytes are read now, into a table. Files beyond
    2 GB are listed and read in pieces, see ``split_variants``.
    """
    files = _listed(spark, directories, content=True)
    named = files.select("path", collection_of(F.col("path")).alias("collection"), N.base_name(F.col("path")).alias("file_name"), *_content(files))
    return named if _content(files) else with_contents(named)


def list_members(files: DataFrame) -> DataFrame:
    """Members of the zip archives among ``files`` (path, collection, file_name), from their directories only.

    Archives are opened where every executor has them mounted, or, if ``files`` has their ``content`` (see
    ``read_contents``), in what Spark has read, from any file system. An unreadable archive gives one row with
    ``error`` and no member.
    """
    def run(batches):
        names = [part.split()[0] for part in MEMBERS.split(", ")]
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                key = (f.collection, f.file_name, f.path)
                try:
                    with zipfile.ZipFile(opened(f)) as archive:
                        found = [m for m in archive.infolist() if not m.is_dir()]
                    rows += [(*key, i, m.filename, m.file_size, m.compress_size, f"{m.CRC:08x}", None)
                             for i, m in enumerate(found)]
                except (zipfile.BadZipFile, OSError) as exc:
                    rows.append((*key, None, None, None, None, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=names).astype(
                {"member_pos": "Int32", "size": "Int64", "compress_size": "Int64"})

    ship(files.sparkSession)
    archives = files.filter(N.extension(F.col("file_name")) == ".zip").select("collection", "file_name", "path", *_content(files))
    return archives.mapInPandas(run, MEMBERS)


def _content(files: DataFrame) -> list[str]:
    return ["content"] if "content" in files.columns else []


READINGS = ("collection string, file_name string, kind string, prefix int, label string, order_found string, hash string, size bigint, "
            "variant_ord int, zero_pct int, error string")
_PREFIXES = [n for n, _ in T.PREFIXES]
_ORDERS = ["byteswapped", "littleendian"]
#: bytes of a file that one task reads: a multiple of 4, longer than any prefix
PIECE = 64 * 1024 * 1024


def measured(stream, most: int | None = None) -> dict:
    """Size, first bytes and checksums of what a stream holds next, at most ``most`` bytes of it, a block at a time.

    Beside the plain checksum there is one without each prefix and one in each other byte order.
    """
    raw, size, head, rest = 0, 0, b"", b""
    stripped, swapped = dict.fromkeys(_PREFIXES, 0), dict.fromkeys(_ORDERS, 0)
    while True:
        block = stream.read(BLOCK if most is None else min(BLOCK, most - size))
        head += block[:max(0, max(_PREFIXES) - len(head))]
        raw = zlib.crc32(block, raw)
        for n in stripped:
            stripped[n] = zlib.crc32(block[max(0, n - size):], stripped[n])
        # groups of four bytes must not straddle what is read at a time
        data = rest + block
        whole = len(data) if not block else len(data) - len(data) % 4
        for order in swapped:
            swapped[order] = zlib.crc32(swap_block(data[:whole], order), swapped[order])
        rest = data[whole:]
        size += len(block)
        if not block:
            return {"size": size, "head": head, "raw": raw, **{f"strip{n}": x for n, x in stripped.items()}, **swapped}


def readings(pieces: list[dict]):
    """(kind, prefix, label, order_found, checksum, size, variant_ord, zero_pct) of a file measured in pieces, in order.

    Checksums of pieces join by their lengths; a prefix lies in the first piece, and pieces hold whole groups of bytes.
    """
    sizes, head = [p["size"] for p in pieces], bytes(pieces[0]["head"])
    size, raws = sum(sizes), [p["raw"] for p in pieces]
    raw = joined(raws, sizes)
    orders = {bytes.fromhex(k): v for k, v in T.BYTE_ORDER_MAGIC.items()}
    found = orders.get(head[:2]) if size >= 4 else None
    yield "raw", None, None, found, raw, size, 0, None
    for i, (n, label) in enumerate(T.PREFIXES, 1):
        if size > n:
            stripped = joined([pieces[0][f"strip{n}"], *raws[1:]], [sizes[0] - n, *sizes[1:]])
            yield "prefix", n, label, found, stripped, size - n, i, head[:n].count(0) * 100 // n
    if found:
        seen = {raw}
        for i, order in enumerate(_ORDERS, 11):
            value = joined([p[order] for p in pieces], sizes)
            if value not in seen:
                seen.add(value)
                yield "swap", None, T.BYTE_ORDER_LABELS[order], found, value, size, i, None


def _rows(collection, file_name, pieces):
    return [(collection, file_name, kind, n, label, found, f"{value:08x}", size, i, zeros, None) for kind, n, label, found, value, size, i, zeros in readings(pieces)]


def _failed(collection, file_name, error: str):
    return collection, file_name, "raw", *[None] * 4, None, 0, None, error


def _frame(rows) -> pd.DataFrame:
    names = [part.split()[0] for part in READINGS.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"prefix": "Int32", "size": "Int64", "variant_ord": "Int32", "zero_pct": "Int32"})


def streamed_variants(files: DataFrame) -> DataFrame:
    """Readings of content of any size, whole files and members of archives, in the columns of ``content_variants``.

    One pass in blocks per file, never holding more than a block. ``files``: collection, file_name, path and, where
    the content is a member of the archive at ``path``, member_name (the primary member, see ``members``). With a column
    ``content`` (see ``read_contents``) files come from any file system Spark reads, and nothing is shuffled.
    A file that cannot be read is one row without a hash, with ``error``; the others go on.
    """
    ship(files.sparkSession)

    def stream(f):
        if not f.member_name:
            return opened(f)
        with zipfile.ZipFile(opened(f)) as archive:
            return archive.open(f.member_name)  # keeps the file open for itself

    def run(batches):
        for pdf in batches:
            rows = []
            for f in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                try:
                    with stream(f) as content:
                        rows += _rows(f.collection, f.file_name, [measured(content)])
                except Exception as exc:  # one bad file must not stop the others
                    rows.append(_failed(f.collection, f.file_name, f"{type(exc).__name__}: {exc}"))
            yield _frame(rows)

    member = F.col("member_name") if "member_name" in files.columns else F.lit(None).cast("string")
    listed = files.select("collection", "file_name", "path", member.alias("member_name"), *_content(files))
    # rows are short whatever the files hold: a given number of partitions keeps them from being merged into one
    return (listed if _content(files) else spread(listed, "path")).mapInPandas(run, READINGS)


def split_variants(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """The readings of ``streamed_variants`` for loose files of any size, each file read in pieces by many tasks.

    ``files`` (collection, file_name, path, size) are mounted on every executor. A task measures its range of a file; what
    comes together per file is a row a piece of a few dozen numbers, from which the checksums of the whole follow. A
    file with a piece that cannot be read, or that no longer has the size it was listed with, is one row with ``error``.
    """
    if piece % 4 or piece < max(_PREFIXES):
        raise ValueError(f"a piece is a multiple of 4 and at least {max(_PREFIXES)} bytes")
    ship(files.sparkSession)
    sums = ["raw", *[f"strip{n}" for n in _PREFIXES], *_ORDERS]
    schema = f"collection string, file_name string, listed bigint, piece bigint, size bigint, head binary, {', '.join(f'{c} bigint' for c in sums)}, error string"
    names = [part.split()[0] for part in schema.split(", ")]

    def measure(batches):
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                key = (f.collection, f.file_name, f.size, f.piece)
                try:
                    with open(local_path(f.path), "rb") as content:
                        content.seek(f.piece * piece)
                        m = measured(content, piece)
                    rows.append((*key, m["size"], m["head"] if f.piece == 0 else b"", *[m[c] for c in sums], None))
                except Exception as exc:
                    rows.append((*key, None, None, *[None] * len(sums), f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("listed", "size", *sums)})

    def put_together(batches):
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                pieces = [p if isinstance(p, dict) else p.asDict() for p in f.pieces]
                errors = [p["error"] for p in pieces if p["error"]]
                if not errors and sum(p["size"] for p in pieces) != f.listed:
                    errors = ["OSError: the file has changed since it was listed"]
                rows += [_failed(f.collection, f.file_name, errors[0])] if errors else _rows(f.collection, f.file_name, pieces)
            yield _frame(rows)

    last = F.greatest(F.ceil(F.col("size") / piece) - 1, F.lit(0))
    ranges = files.select("collection", "file_name", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    parts = spread(ranges, "path", "piece").mapInPandas(measure, schema)
    # a row a piece, as many as the file has
    whole = parts.groupBy("collection", "file_name", "listed").agg(F.array_sort(F.collect_list(F.struct(*names[3:]))).alias("pieces"))
    return whole.mapInPandas(put_together, READINGS)


def embedded_sha1(content: Column) -> Column:
    """Digest stored in a disc image header; NULL for other content, versions or an all-zero digest."""
    tag = F.substring(content, 1, 8) == F.lit(T.DISC_TAG)
    version = F.conv(F.hex(F.substring(content, 13, 4)), 16, 10).cast("bigint") == T.DISC_VERSION
    digest = F.lower(F.hex(F.substring(content, 65, 20)))
    whole = F.octet_length(content) >= 124
    return F.when(whole & tag & version & (digest != "0" * 40), digest)
