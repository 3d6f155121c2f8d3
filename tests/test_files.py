"""Catalogues, inventories and packages on disk, from scan to export."""

import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import binary as B
from shelfmark.functions import dispatch as D
from shelfmark.operators import candidates as C
from shelfmark.operators import hash_match as H
from shelfmark.operators import members as ME
from shelfmark.operators import reconcile as R
from shelfmark.plans import rules as PR
from shelfmark.plans import writer as W
from shelfmark.sources import catalogs as CA
from shelfmark.sources import inventory as IN

COLLECTION = "Nintendo - Super Nintendo Entertainment System"
HELD = {
    "Game Alpha (USA)": b"alpha rom data here", "Game Beta (Japan)": b"beta rom data here",
    "Game Gamma Test (Europe)": b"gamma test rom data", "Game Delta (USA)": b"delta rom data here",
    "Test Suite (World)": b"test suite rom data",
}
GONE = ["Missing One (USA)", "Missing Two (USA)", "Missing Three (USA)"]


def catalog_xml(name, sets, ext=".sfc"):
    games = "".join(
        f'<game name="{n}"><description> {n} </description><rom name="{n}{ext}" size="{size}" crc="{crc}"/></game>\n'
        for n, size, crc in sets)
    return f"<?xml version='1.0'?>\n<datafile>\n<header><name>{name}</name><description>d</description><version>1</version></header>\n{games}</datafile>"


def crc(data):
    return f"{zlib.crc32(data):08x}"


@pytest.fixture
def shelf(tmp_path):
    cats, files = tmp_path / "catalogs", tmp_path / "files" / COLLECTION
    cats.mkdir()
    files.mkdir(parents=True)
    sets = [(n, len(x), crc(x)) for n, x in HELD.items()] + [(n, 0, "00000000") for n in GONE]
    (cats / "snes list.dat").write_text(catalog_xml(COLLECTION + " (Parent-Clone)", sets))
    for n, x in HELD.items():
        with zipfile.ZipFile(files / f"{n}.zip", "w") as z:
            z.writestr(f"{n}.sfc", x)
    return tmp_path


def entries_of(spark, shelf):
    heads = CA.read_headers(spark, str(shelf / "catalogs")).select(
        F.regexp_extract("catalog_path", "([^/]+)$", 1).alias("k"), F.col("name").alias("catalog"), "collection")
    rows = CA.read_entries(spark, str(shelf / "catalogs")).withColumn("k", F.regexp_extract("catalog_path", "([^/]+)$", 1))
    return rows.join(heads, "k").withColumn("hash", F.col("crc"))


def test_scan_and_reconcile(spark, shelf):
    entries = entries_of(spark, shelf)
    assert entries.select("collection").distinct().collect()[0][0] == COLLECTION
    assert entries.filter("set_name = 'Game Beta (Japan)'").first().description == "Game Beta (Japan)"
    files = IN.list_files(spark, str(shelf / "files" / COLLECTION))
    assert files.count() == 5 and {r.collection for r in files.collect()} == {COLLECTION}
    members = IN.list_members(files)
    hashes = members.select("collection", "file_name", "member_name", F.col("crc").alias("hash"))
    sets = R.set_results(R.entry_results(entries, hashes))
    status = {r.set_name: r.status for r in sets.collect()}
    assert status == {**{n: "ok" for n in HELD}, **{n: "missing" for n in GONE}}
    assert R.unmatched_files(hashes, entries).count() == 0
    first = sets.filter("set_name = 'Test Suite (World)'").first()
    assert (first.file_name, first.member_name, first.expected_file_name) == (
        "Test Suite (World).zip", "Test Suite (World).sfc", "Test Suite (World).zip")


def test_scan_does_not_read_content(spark, shelf):
    plan = IN.list_files(spark, str(shelf / "files" / COLLECTION))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_bad_archive_is_a_row(spark, shelf):
    (shelf / "files" / COLLECTION / "broken.zip").write_bytes(b"not a zip")
    rows = IN.list_members(IN.list_files(spark, str(shelf / "files" / COLLECTION))).collect()
    bad = [r for r in rows if r.error]
    assert len(bad) == 1 and bad[0].file_name == "broken.zip" and bad[0].member_name is None and len(rows) == 6


def test_broken_catalog_gives_no_rows(spark, tmp_path):
    whole = catalog_xml("Whole", [(f"S{i}", 4, "00000012") for i in range(8)])
    (tmp_path / "good.dat").write_text(whole)
    (tmp_path / "cut.dat").write_text(whole[: len(whole) * 2 // 3])
    with zipfile.ZipFile(tmp_path / "cut.zip", "w") as z:
        z.writestr("list.dat", whole[: len(whole) * 2 // 3])
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as z:
        z.writestr("list.dat", whole.replace('size="4"', 'size="four"').replace("size='4'", "size='four'"))
    names = {os.path.basename(r.catalog_path) for r in CA.read_entries(spark, str(tmp_path)).select("catalog_path").distinct().collect()}
    assert names == {"good.dat"}
    assert sorted(os.path.basename(r.catalog_path) for r in CA.rejected_catalogs(spark, str(tmp_path)).collect()) == ["cut.dat", "cut.zip"]
    zipped = CA.read_zipped_entries(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.catalog_path), r.size) for r in zipped if not r.error) == [("odd.zip", 0)] * 8


def test_catalog_variants(spark, tmp_path):
    (tmp_path / "plain.dat").write_text("<datafile><game name='Empty'/><game name='A'><rom name='a.bin'/><rom name='b.bin' size='3' crc='0000000A'/></game></datafile>")
    inner = catalog_xml("Zipped", [("Z", 4, "00000012")])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("list.xml", catalog_xml("Other", []))
        z.writestr("list.DAT", inner)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "x")
    plain = CA.read_entries(spark, str(tmp_path)).orderBy("set_pos", "entry_pos").collect()
    assert [(r.set_name, r.entry_pos, r.entry_name, r.size, r.crc) for r in plain] == [
        ("Empty", None, None, None, None), ("A", 0, "a.bin", 0, None), ("A", 1, "b.bin", 3, "0000000a")]
    head = CA.read_headers(spark, str(tmp_path)).first()
    assert (head.name, head.collection) == ("plain", "plain")
    found = [(r.catalog_group, os.path.basename(r.catalog_path), r.collection) for r in CA.discover_catalogs(spark, str(tmp_path)).orderBy(
        "catalog_group", "catalog_path").collect()]
    assert found == [(0, "plain.dat", "plain"), (1, "z.zip", "Zipped")]
    zipped = CA.read_zipped_entries(spark, str(tmp_path)).collect()
    good = [r for r in zipped if not r.error]
    assert [(r.set_name, r.entry_name, r.crc, r.size) for r in good] == [("Z", "Z.sfc", "00000012", 4)]
    assert [os.path.basename(r.catalog_path) for r in CA.rejected_catalogs(spark, str(tmp_path)).collect()] == ["none.zip"]


BIG = bytes.fromhex("80371240") + bytes.fromhex("AABBCCDD") * 31
N64 = "Nintendo - Nintendo 64 (BigEndian)"


@pytest.mark.parametrize("order, confirmed", [("byteswapped", 1), ("littleendian", 1), (None, 0)])
def test_byte_order_candidates(spark, order, confirmed):
    data = W.swap_block(BIG, order) if order else BIG
    files = spark.createDataFrame([(N64, "Game (USA).v64", bytearray(data))], "collection string, file_name string, content binary")
    variants = B.content_variants(files, ["collection", "file_name"], swap=D.swaps_bytes(F.col("collection")))
    entries = spark.createDataFrame(
        [(N64, N64, 0, "Game (USA)", 0, "Game (USA).z64", 128, "e98742ae")],
        "collection string, catalog string, set_pos bigint, set_name string, entry_pos int, entry_name string, size bigint, hash string")
    swaps = H.swapped_candidates(variants, entries).collect()
    assert len(swaps) == confirmed and all(r.hash == "e98742ae" and r.confidence == 1.0 for r in swaps)
    best = C.best_per_file(C.gather(files.select("collection", "file_name"), variants, entries)).first()
    assert best.status == "matched" and best.set_name == "Game (USA)" and best.stage == (3 if order else 1)


def jobs(spark, path, collection, set_name, entry_name, accepted_member=None, data=b"", source_type=None):
    name = os.path.basename(path)
    source = source_type or os.path.splitext(name)[1].lower()
    rows = [(collection, collection, name, set_name, entry_name, source, bytearray(data))]
    df = spark.createDataFrame(
        rows, "collection string, catalog string, file_name string, set_name string, entry_name string, source_type string, content binary")
    return df.select(
        "*", F.octet_length("content").cast("bigint").alias("size"), B.byte_order(F.col("content")).alias("order_found"),
        F.create_map(F.lit(512), B.zero_share(F.col("content"), 512), F.lit(16), B.zero_share(F.col("content"), 16)).alias("zero_pct"),
        (F.octet_length("content") > 0).alias("readable")).drop("content")


def export(spark, path, job, dest, **options):
    listed = spark.createDataFrame([(job.first().collection, os.path.basename(path), str(path))], "collection string, file_name string, path string")
    members = IN.list_members(listed).filter("error is null")
    headers, steps = PR.plan_headers(job, members), PR.plan_steps(job, members)
    located = listed.withColumnRenamed("path", "source_path")
    manifest = W.write_exports(W.export_jobs(headers, steps, located), str(dest), **options).collect()
    return headers.first(), {r.name: r for r in steps.collect()}, manifest


def test_strip_and_package(spark, tmp_path):
    body = bytes([0xAB]) * 1024
    source = tmp_path / "game.smc"
    source.write_bytes(bytes(512) + body)
    job = jobs(spark, source, "Super Nintendo", "Game (USA)", "Game (USA).sfc", data=bytes(512) + body)
    root = tmp_path / "out" / "deep"
    header, steps, manifest = export(spark, source, job, root)
    dest = root / "Super Nintendo"
    assert list(steps) == ["strip_header", "rename_ext", "compress_package"] and steps["strip_header"].params["header_size"] == "512"
    assert header.summary == "strip_header → rename_ext → compress_package" and header.plan_label == "modify"
    assert [r.error for r in manifest] == [None] and manifest[0].bytes == 1024
    with zipfile.ZipFile(dest / "Game (USA).zip") as z:
        assert z.namelist() == ["Game (USA).sfc"] and z.read("Game (USA).sfc") == body
    assert os.listdir(dest) == ["Game (USA).zip"]


def test_embedded_files(spark, tmp_path):
    source = tmp_path / "g.zip"
    with zipfile.ZipFile(source, "w") as z:
        z.writestr("readme.txt", "x" * 5000)
        z.writestr("g.z64", BIG)
    job = jobs(spark, source, "Nintendo 64", "Game (USA)", "Game (USA).z64", data=BIG, source_type=".z64")
    header, steps, _ = export(spark, source, job, tmp_path / "a")
    assert list(steps) and "rename_ext" not in steps and steps["remove_embedded"].params == {"filename": "readme.txt"}
    with zipfile.ZipFile(tmp_path / "a" / "Nintendo 64" / "Game (USA).zip") as z:
        assert z.namelist() == ["Game (USA).z64"] and z.read("Game (USA).z64") == BIG
    export(spark, source, job, tmp_path / "b", primary_only=False)
    with zipfile.ZipFile(tmp_path / "b" / "Nintendo 64" / "Game (USA).zip") as z:
        assert sorted(z.namelist()) == ["Game (USA).z64", "readme.txt"]


@pytest.mark.parametrize("convert, name, content", [(True, "Game (USA).z64", BIG), (False, "Game (USA).v64", W.swap_block(BIG, "byteswapped"))])
def test_byte_order_conversion(spark, tmp_path, convert, name, content):
    data = W.swap_block(BIG, "byteswapped")
    source = tmp_path / "g.v64"
    source.write_bytes(data)
    job = jobs(spark, source, "Nintendo 64", "Game (USA)", "Game (USA).z64", data=data)
    _, steps, _ = export(spark, source, job, tmp_path / "o", convert=convert)
    assert steps["convert_byteorder"].params["to_fmt"] == "bigendian"
    with zipfile.ZipFile(tmp_path / "o" / "Nintendo 64" / "Game (USA).zip") as z:
        assert z.namelist() == [name] and z.read(name) == content


def test_loose_file_keeps_extension(spark, tmp_path):
    source = tmp_path / "Some Game.chd"
    source.write_bytes(b"disc")
    job = jobs(spark, source, "Sony - PlayStation", "Some Game (USA)", "Some Game (USA).bin", data=b"disc")
    header, steps, manifest = export(spark, source, job, tmp_path / "o")
    assert list(steps) == ["loose_file"] and header.target_name == "Some Game (USA).chd"
    assert (tmp_path / "o" / "Sony - PlayStation" / "Some Game (USA).chd").read_bytes() == b"disc"


def test_no_steps_copies_and_errors_are_rows(spark, tmp_path):
    source = tmp_path / "x.sfc"
    source.write_bytes(b"data")
    other = tmp_path / "y.sfc"
    other.write_bytes(b"other")
    schema = ("collection string, file_name string, catalog string, source_path string, target_name string, n_steps bigint, strip_bytes bigint, "
              "inner_name string, from_fmt string, to_fmt string, new_ext string")
    rows = [("c", "x.sfc", "c", str(source), "Y (USA).sfc", 0, 0, None, None, None, None),
            ("c", "gone.sfc", "c", str(tmp_path / "gone.sfc"), "Z.sfc", 0, 0, None, None, None, None),
            ("c", "a.sfc", "c", str(source), "Y (USA).sfc", 0, 0, None, None, None, None),
            ("d", "y.sfc", "d", str(other), "Y (USA).sfc", 0, 0, None, None, None, None)]
    (tmp_path / "o" / "c").mkdir(parents=True)
    (tmp_path / "o" / "c" / "Y (USA).sfc").write_bytes(b"old")
    got = {r.file_name: r for r in W.write_exports(spark.createDataFrame(rows, schema), str(tmp_path / "o")).collect()}
    assert got["x.sfc"].error is None and got["gone.sfc"].error.startswith("FileNotFoundError")
    assert len(got) == 4 and got["a.sfc"].error == "replaced by x.sfc" and got["y.sfc"].error is None
    assert (tmp_path / "o" / "c" / "Y (USA).sfc").read_bytes() == b"data" and (tmp_path / "o" / "d" / "Y (USA).sfc").read_bytes() == b"other"


def test_rebuild_sets(spark, tmp_path):
    one, two = tmp_path / "one.bin", tmp_path / "two.zip"
    one.write_bytes(b"first")
    with zipfile.ZipFile(two, "w") as z:
        z.writestr("inner.bin", b"second")
    rows = [("c", "S", 1, "b.bin", str(two), "inner.bin"), ("c", "S", 0, "a.bin", str(one), None), ("c", "T", 0, "t.bin", str(one), None),
            ("d", "S", 0, "s.bin", str(one), None), ("d", "U", 0, "a.bin", str(tmp_path / "gone.bin"), None), ("d", "U", 1, "b.bin", str(one), None)]
    df = spark.createDataFrame(rows, "collection string, set_name string, entry_pos int, entry_name string, source_path string, member_name string")
    manifest = W.write_sets(df, str(tmp_path / "o")).collect()
    assert sorted((r.collection, r.target_name, r.bytes or -1) for r in manifest) == [
        ("c", "S.zip", 11), ("c", "T.zip", 5), ("d", "S.zip", 5), ("d", "U.zip", -1)]
    assert [r.error.split(":")[0] for r in manifest if r.error] == ["FileNotFoundError"]
    assert os.listdir(tmp_path / "o" / "d") == ["S.zip"]
    with zipfile.ZipFile(tmp_path / "o" / "c" / "S.zip") as z:
        assert z.namelist() == ["a.bin", "b.bin"] and z.read("b.bin") == b"second"


@pytest.mark.parametrize("collection, members, kind", [
    ("Homebrew", [("Game (USA).z64", 64)], "z64"),
    ("Homebrew", [("README.txt", 270), ("Game (USA).v64", 1026)], "v64"),
    ("Nintendo 64", [("README.txt", 5000), ("Game.z64", 102)], "z64"),
    ("Nintendo 64", [("a.txt", 10), ("b.txt", 10)], "txt"),
])
def test_primary_member(spark, collection, members, kind):
    rows = [(collection, "f.zip", i, n, size, "x") for i, (n, size) in enumerate(members)]
    df = spark.createDataFrame(rows, "collection string, file_name string, member_pos int, member_name string, size bigint, crc string")
    got = ME.primary_members(df, D.accepted_types(F.col("collection"))).first()
    assert got.member_type == kind and got.n_members == len(members)
    if kind == "txt":
        assert got.member_name == "a.txt"
