"""Files made from the documents lie in folders of bounded size, so that many tasks list them."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameReader

from shelfmark.sources import inventory as IN
from workload import filing as FI
from workload import frames as fr
from workload import streaming as ST


def test_folders_do_not_grow(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(FI, "SHELVED", 20, raising=False)
    root = FI._doc_shelf(spark, d).removeprefix("file://").removeprefix("file:")
    held = [len(files) for _, _, files in os.walk(root) if files]
    n = fr.table(spark, d, "documents").count()
    assert sum(held) == n and max(held) <= 20 and len(held) > 32
    assert FI._doc_list(spark, d).count() == n


def test_exports_are_listed_once(spark, monkeypatch):
    listed = []
    for name in ("list_files", "read_contents"):
        plain = getattr(FI.IN, name)
        monkeypatch.setattr(FI.IN, name, lambda spark, *folders, plain=plain: listed.extend(folders) or plain(spark, *folders))
    rows = FI.exported_with_steps(spark, "/root/testdata/sf0.001").collect()
    assert all(r.same for r in rows) and len(listed) == len(set(listed)) == 2


def test_mounted_folders_are_listed_by_tasks(spark, tmp_path):
    """Spark's own listing sends a row a file to the driver, plans a task for a few files, and leaves out empty ones."""
    for k in range(300):
        place = tmp_path / f"folder {k % 30}" / "sub"
        place.mkdir(parents=True, exist_ok=True)
        (place.parent / f"file%20{k}.bin").write_bytes(b"x" * (k % 3))
        (place / "deeper.bin").write_bytes(b"deep")
        (place.parent / "_left.bin").write_bytes(b"out")
    files = IN.list_files(spark, f"{tmp_path}/*")
    rows = {(r.collection, r.file_name): r.size for r in files.collect()}
    assert rows == {(f"folder {k % 30}", f"file%20{k}.bin"): k % 3 for k in range(300)}
    held = IN.read_contents(spark, f"{tmp_path}/*")
    assert {r.file_name: len(r.content) for r in held.collect()} == {name: size for (_, name), size in rows.items()}
    assert files.rdd.getNumPartitions() <= 16 and "binaryFile" not in files._jdf.queryExecution().toString()
    # short rows are kept apart by a given number of partitions, else all files meet in one task
    assert "REPARTITION_BY_COL" not in IN.streamed_variants(files)._jdf.queryExecution().toString()


def test_packages_lie_in_folders_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(FI, "PACKED", 5, raising=False)
    rows, dest = FI._packages(spark, "/root/testdata/sf0.001")
    held = [len(files) for _, _, files in os.walk(dest.removeprefix("file://").removeprefix("file:")) if files]
    assert sum(held) == rows.count() and max(held) <= 5


def test_written_catalogues_do_not_grow(spark, monkeypatch):
    """A task reads a catalogue as a whole."""
    monkeypatch.setattr(ST, "GAMES", 50, raising=False)
    read = []
    plain = ST.CA.read_entries
    monkeypatch.setattr(ST.CA, "read_entries", lambda spark, path, *a: read.append(path) or plain(spark, path, *a))
    n = ST.catalog_scan(spark, "/root/testdata/sf0.001").count()
    place = read[0].removeprefix("file://").removeprefix("file:")
    held = [open(os.path.join(place, x)).read().count("<game ") for x in os.listdir(place) if x.startswith("part-")]
    assert sum(held) == n == 200 and max(held) <= 50


def test_stores_are_listed_a_group_of_folders_at_a_time(spark, tmp_path, monkeypatch):
    """A driver that lists at once holds a row a file, and asking where each lies costs a look-up a file, over a local folder a process."""
    for name, n in (("FOLDERS", 3), ("NAMED", 20), ("SMALL", 100)):
        monkeypatch.setattr(IN, name, n, raising=False)
    for k in range(60):
        place = tmp_path / "in" / f"folder [{k % 12}]"
        (place / "sub").mkdir(parents=True, exist_ok=True)
        (place / "sub" / "deeper.bin").write_bytes(b"deep")
        (place / f"file {k} [!].bin").write_bytes(b"x" * 3 * k)
        (place / "_left.bin").write_bytes(b"out")
    (tmp_path / "in" / "none").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelftest.link./in", f"file://{tmp_path}/in")
    seen, plain, key = [], DataFrameReader.load, "spark.sql.sources.ignoreDataLocality"
    before = spark.conf.get(key)
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **k: seen.append((path, spark.conf.get(key))) or plain(self, path, *a, **k))
    want = sorted((f"folder [{k % 12}]", f"file {k} [!].bin", 3 * k) for k in range(1, 60))  # empty ones are left out there
    files, held = IN.list_files(spark, "viewfs://shelftest/in/*"), IN.read_contents(spark, "viewfs://shelftest/in/*")
    assert sorted((r.collection, r.file_name, r.size) for r in files.collect()) == want
    assert sorted((r.collection, r.file_name, len(r.content)) for r in held.collect()) == want
    # a path given twice is read twice
    assert IN.read_contents(spark, *["viewfs://shelftest/in/*"] * 2).count() == 2 * len(want)
    assert not [f for f in files.inputFiles() if "shelftest" in f]
    assert len([f for f in held.inputFiles() if "shelftest" in f]) == len([s for *_, s in want if s > 100])
    assert {local for _, local in seen} == {"true"} and spark.conf.get(key) == before
    # few folders are read where they are used
    assert len(IN.read_contents(spark, "viewfs://shelftest/in/folder \\[[12]\\]").inputFiles()) == 10
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        IN.list_files(spark, "viewfs://shelftest/in/*", "viewfs://shelftest/in/gone*")
