"""Write planned files. Each task streams its files from source to target; nothing passes the driver.

Targets are written beside their final name and moved into place, so a retried or speculative
task leaves the same result.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import tables as T
from shelfmark.session import ship, spread

BLOCK = 8 * 1024 * 1024  # multiple of 4, so byte groups never straddle blocks
MANIFEST = "collection string, file_name string, target_name string, bytes bigint, error string"
TYPE_BY_ORDER = {order: ext for ext, order in T.BYTE_ORDER_BY_TYPE.items()}


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def opened(row, path: str = "path"):
    """A seekable stream of a row's file: what Spark has read of it, if the row has ``content``, else the mounted file at its path."""
    content = getattr(row, "content", None)
    return io.BytesIO(content) if content is not None else open(local_path(getattr(row, path)), "rb")


def folder(dest: str, collection: str | None) -> str:
    """Where a collection's files go: targets of two collections never meet."""
    return os.path.join(dest, (collection or "_").replace("/", "_"))


def suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def pick_member(archive: zipfile.ZipFile, preferred: str) -> zipfile.ZipInfo:
    """Largest member of the preferred type, or of all when there is none; the first on ties."""
    members = [m for m in archive.infolist() if not m.is_dir()]
    chosen = [m for m in members if preferred and suffix(m.filename) == preferred] or members
    return max(chosen, key=lambda m: m.file_size)


def swap_block(block: bytes, order: str) -> bytes:
    width = {"byteswapped": 2, "littleendian": 4}.get(order)
    if not width:
        return block
    whole = len(block) - len(block) % width
    head = np.frombuffer(block[:whole], dtype=np.uint8).reshape(-1, width)[:, ::-1]
    return head.tobytes() + block[whole:]


def _blocks(stream, skip: int, orders: tuple[str, ...]) -> Iterator[bytes]:
    while skip > 0:
        taken = stream.read(min(skip, BLOCK))
        if not taken:
            return
        skip -= len(taken)
    rest = b""
    while True:
        block = stream.read(BLOCK)
        data = rest + block
        cut = len(data) if not block else len(data) - len(data) % 4
        out, rest = data[:cut], data[cut:]
        for order in orders:
            out = swap_block(out, order)
        if out:
            yield out
        if not block:
            return


def _copy(stream, out, skip: int = 0, orders: tuple[str, ...] = ()) -> int:
    total = 0
    for block in _blocks(stream, skip, orders):
        out.write(block)
        total += len(block)
    return total


def _write(job, dest: str, primary_only: bool, convert: bool) -> tuple[str, int]:
    packed = suffix(job.source_path) == ".zip"
    has_steps = job.n_steps > 0
    orders: tuple[str, ...] = ()
    preferred = suffix(job.inner_name) if job.inner_name else ""
    inner = job.inner_name
    if convert and job.from_fmt:
        orders = (job.from_fmt, job.to_fmt)
        preferred = TYPE_BY_ORDER.get(job.from_fmt, preferred)
        if inner:
            inner = os.path.splitext(inner)[0] + job.new_ext
    target, dest = job.target_name, folder(dest, job.collection)
    os.makedirs(dest, exist_ok=True)
    partial = os.path.join(dest, f".{uuid.uuid4().hex}.part")
    try:
        unpack = packed and (has_steps or suffix(target) != ".zip")
        archive = zipfile.ZipFile(opened(job, "source_path")) if unpack else None
        try:
            main = pick_member(archive, preferred) if archive else None
            stream = archive.open(main) if archive else opened(job, "source_path")
            with stream:
                if job.inner_name:
                    with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED) as out:
                        with out.open(inner, "w", force_zip64=True) as member:
                            n = _copy(stream, member, job.strip_bytes, orders)
                        if archive and not primary_only:
                            for extra in archive.infolist():
                                if extra.is_dir() or suffix(extra.filename) == preferred:
                                    continue
                                with archive.open(extra) as src, out.open(extra.filename, "w", force_zip64=True) as member:
                                    _copy(src, member)
                else:
                    with open(partial, "wb") as out:
                        n = _copy(stream, out, job.strip_bytes, orders)
        finally:
            if archive:
                archive.close()
        os.replace(partial, os.path.join(dest, target))
    except BaseException:
        if os.path.exists(partial):
            os.unlink(partial)
        raise
    return target, n


def export_jobs(headers: DataFrame, steps: DataFrame, located: DataFrame) -> DataFrame:
    """One row per file to write. ``located``: collection, file_name, source_path."""
    def of(name, key):
        return F.max(F.when(F.col("name") == name, F.col("params")[key]))

    job = ["collection", "catalog", "file_name"]
    # removals need no parameter here: packages are written from scratch
    flat = steps.filter(F.col("name") != "remove_embedded").groupBy(*job).agg(
        of("strip_header", "header_size").cast("bigint").alias("strip_bytes"),
        of("compress_package", "inner_name").alias("inner_name"),
        of("convert_byteorder", "from_fmt").alias("from_fmt"),
        of("convert_byteorder", "to_fmt").alias("to_fmt"),
        of("convert_byteorder", "new_ext").alias("new_ext"),
    )
    return headers.join(flat, job, "left").join(located, ["collection", "file_name"]).fillna({"strip_bytes": 0})


def write_exports(jobs: DataFrame, dest: str, primary_only: bool = True, convert: bool = False) -> DataFrame:
    """Write every job into its collection's folder under ``dest``; returns a manifest row for each job.

    Sources are mounted files at ``source_path``, or the ``content`` of the jobs, which Spark has read from any file system;
    the target folder is one every executor has mounted. A failing file gives a row with its error. Of several files of a collection with one target the last by name is
    written, as when written one after another; the others get a row that names it.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for job in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                try:
                    target, n = _write(job, dest, primary_only, convert)
                    rows.append((job.collection, job.file_name, target, n, None))
                except Exception as exc:  # one bad file must not stop the others
                    rows.append((job.collection, job.file_name, job.target_name, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["collection", "file_name", "target_name", "bytes", "error"]).astype(
                {"bytes": "Int64"})

    ship(jobs.sparkSession)
    target = ["collection", "target_name"]
    key = F.struct("file_name", "catalog")
    last = jobs.groupBy(*target).agg(F.max(key).alias("_last"))
    ranked = jobs.join(last, target)
    chosen = ranked.filter(key == F.col("_last")).drop("_last")
    # content stays where it was read
    written = (chosen if "content" in jobs.columns else spread(chosen, *target)).mapInPandas(run, MANIFEST)
    replaced = ranked.filter(key != F.col("_last")).select(
        "collection", "file_name", "target_name", F.lit(None).cast("bigint").alias("bytes"),
        F.concat(F.lit("replaced by "), "_last.file_name").alias("error"))
    return written.unionByName(replaced)


def write_sets(entries: DataFrame, dest: str) -> DataFrame:
    """Rebuild packages from loose or packed sources: one package per set, members in entry order.

    ``entries``: collection, set_name, entry_pos, entry_name, source_path, member_name (complete
    sets only, see ``rebuildable_sets``). Rows arrive sorted, so a package is streamed member by member.
    A set with a source that cannot be read is a manifest row with the error; nothing is left of it.
    """
    ship(entries.sparkSession)

    class Package:
        def __init__(self, collection, set_name):
            self.collection, self.set_name, self.target = collection, set_name, f"{set_name}.zip"
            self.count, self.error, self.out, self.partial = 0, None, None, None
            try:
                place = folder(dest, collection)
                os.makedirs(place, exist_ok=True)
                self.path = os.path.join(place, self.target)
                self.partial = os.path.join(place, f".{uuid.uuid4().hex}.part")
                self.out = zipfile.ZipFile(self.partial, "w", zipfile.ZIP_DEFLATED)
            except OSError as exc:
                self.error = f"{type(exc).__name__}: {exc}"

        def add(self, row):
            if self.error:
                return
            try:
                with self.out.open(row.entry_name, "w", force_zip64=True) as member:
                    if row.member_name:
                        with zipfile.ZipFile(opened(row, "source_path")) as archive, archive.open(row.member_name) as src:
                            self.count += _copy(src, member)
                    else:
                        with opened(row, "source_path") as src:
                            self.count += _copy(src, member)
            except Exception as exc:  # one bad source must not stop other sets
                self.error = f"{type(exc).__name__}: {exc}"

        def finish(self):
            if self.out:
                self.out.close()
            if self.error:
                self.drop()
            else:
                os.replace(self.partial, self.path)
            self.partial = None
            row = (self.collection, self.set_name, self.target, None if self.error else self.count, self.error)
            return pd.DataFrame([row], columns=["collection", "file_name", "target_name", "bytes", "error"]).astype({"bytes": "Int64"})

        def drop(self):
            if self.partial and os.path.exists(self.partial):
                os.unlink(self.partial)

    def run(batches):
        current = None
        try:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if not current or (row.collection, row.set_name) != (current.collection, current.set_name):
                        if current:
                            yield current.finish()
                        current = Package(row.collection, row.set_name)
                    current.add(row)
            if current:
                yield current.finish()
        finally:
            if current:
                current.drop()

    cols = ["collection", "set_name", "entry_pos", "entry_name", "source_path", "member_name"]
    return (
        spread(entries.select(*cols), "collection", "set_name")
        .sortWithinPartitions("collection", "set_name", "entry_pos").mapInPandas(run, MANIFEST)
    )


def extra_members(members: DataFrame, primary: DataFrame) -> DataFrame:
    """Members kept beside the primary one: all whose type differs from it."""
    main = primary.select("collection", "file_name", F.col("member_type").alias("primary_type"))
    return members.join(main, ["collection", "file_name"]).filter(
        N.member_type(F.col("member_name")) != F.col("primary_type"))
