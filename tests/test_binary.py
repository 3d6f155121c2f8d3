import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import binary as B
from shelfmark.plans import writer
from shelfmark.sources import inventory as IN
from shelfmark.sources.inventory import embedded_sha1, split_variants, streamed_variants

BIG = bytes.fromhex("80371240") + bytes.fromhex("AABBCCDD") * 31


def swapped(data, width):
    whole = len(data) - len(data) % width
    return b"".join(data[i:i + width][::-1] for i in range(0, whole, width)) + data[whole:]


def crc(data):
    return f"{zlib.crc32(data):08x}"


def rows(spark, *contents):
    return spark.createDataFrame(
        [("c", f"f{i}", bytearray(x)) for i, x in enumerate(contents)], "collection string, file_name string, content binary")


def test_magic_and_swaps(spark):
    data = [BIG, swapped(BIG, 2), swapped(BIG, 4), b"\x80\x37\x12", b"", b"abcdefg"]
    c = F.col("content")
    got = rows(spark, *data).select(
        B.byte_order(c), B.swap_bytes(c, "byteswapped"), B.swap_bytes(c, "littleendian"), B.digest(c)).collect()
    assert [r[0] for r in got] == ["bigendian", "byteswapped", "littleendian", None, None, None]
    for r, x in zip(got, data):
        assert bytes(r[1]) == swapped(x, 2) and bytes(r[2]) == swapped(x, 4) and r[3] == crc(x)
    assert [r[3] for r in got[:3]] == ["e98742ae", "e6f55afd", "63d8acf8"]


def test_swaps_undo_themselves(spark):
    c = F.col("content")
    for order in ("byteswapped", "littleendian"):
        r = rows(spark, BIG, b"12345").select(B.swap_bytes(B.swap_bytes(c, order), order).alias("v")).collect()
        assert [bytes(x.v) for x in r] == [BIG, b"12345"]


def test_reencode(spark):
    got = rows(spark, swapped(BIG, 2)).select(
        B.reencode(F.col("content"), F.lit("byteswapped"), F.lit("littleendian")).alias("v")).first().v
    assert bytes(got) == swapped(BIG, 4)


def test_prefix(spark):
    body = b"\xab" * 1024
    whole = bytes(512) + body
    v = {(r.kind, r.prefix): r for r in B.content_variants(rows(spark, whole), ["collection", "file_name"]).collect()}
    assert v["raw", None].hash == "aaf1f71e" and v["prefix", 512].hash == "2958b94e" == crc(body)
    assert v["prefix", 512].zero_pct == 100 and v["prefix", 512].size == 1024 and ("prefix", 8192) not in v


@pytest.mark.parametrize("content", [BIG, bytes(512) + BIG * 9, b"", b"x", swapped(BIG, 2) + b"odd", bytes(20000)])
def test_streamed_equals_whole(spark, tmp_path, content):
    path = tmp_path / "f0"
    path.write_bytes(content)
    whole = B.content_variants(rows(spark, content), ["collection", "file_name"], swap=F.lit(True))
    keys = ["kind", "prefix", "label", "hash", "size", "order_found", "variant_ord", "zero_pct"]
    listed = spark.createDataFrame([("c", "f0", str(path))], "collection string, file_name string, path string")
    assert sorted(map(str, streamed_variants(listed).select(*keys).collect())) == sorted(map(str, whole.select(*keys).collect()))


@pytest.mark.parametrize("content", [BIG * 90, b"", b"x", swapped(BIG * 60, 4) + b"odd", bytes(8192), bytes(8193), swapped(BIG * 60, 2)])
def test_split_equals_streamed(spark, tmp_path, content):
    """A file read in pieces by many tasks has the readings of one pass, in any file of a folder."""
    for i in range(3):
        (tmp_path / f"f{i}").write_bytes(content * i)
    rows = [("c", f"f{i}", str(tmp_path / f"f{i}"), len(content) * i) for i in range(3)]
    listed = spark.createDataFrame(rows, "collection string, file_name string, path string, size long")
    got = split_variants(listed, piece=8192)
    assert sorted(map(str, got.collect())) == sorted(map(str, streamed_variants(listed).collect()))


def test_split_errors_and_tasks(spark, tmp_path):
    (tmp_path / "short").write_bytes(bytes(30_000))
    (tmp_path / "good").write_bytes(BIG * 100)
    rows = [("c", "short", str(tmp_path / "short"), 50_000), ("c", "gone", str(tmp_path / "gone"), 9_000), ("c", "good", str(tmp_path / "good"), len(BIG) * 100)]
    listed = spark.createDataFrame(rows, "collection string, file_name string, path string, size long")
    got = {r.file_name: r for r in split_variants(listed, piece=8192).collect() if r.kind == "raw"}
    assert got["good"].hash == crc(BIG * 100) and got["good"].error is None
    assert "changed" in got["short"].error and "FileNotFoundError" in got["gone"].error and got["short"].hash is None
    with pytest.raises(ValueError):
        split_variants(listed, piece=1001)


def test_content_from_any_store(spark, tmp_path):
    """Listing, readings and exports of files whose path only Spark can open."""
    (tmp_path / "shelf" / "c").mkdir(parents=True)
    (tmp_path / "shelf" / "c" / "a.bin").write_bytes(BIG)
    with zipfile.ZipFile(tmp_path / "shelf" / "c" / "g.zip", "w") as z:
        z.writestr("g.v64", swapped(BIG, 2))
    (tmp_path / "shelf" / "c" / "bad.zip").write_bytes(b"no archive")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.binarytest.link./in", f"file://{tmp_path}/shelf")
    files = IN.read_contents(spark, "viewfs://binarytest/in/c")
    members = {(r.file_name, r.member_name): r for r in IN.list_members(files).collect()}
    assert members["g.zip", "g.v64"].size == len(BIG) and "BadZipFile" in members["bad.zip", None].error
    inside = files.withColumn("member_name", F.when(F.col("file_name") == "g.zip", "g.v64"))
    got = {(r.file_name, r.kind, r.order_found): r.hash for r in streamed_variants(inside).where("prefix IS NULL").collect()}
    assert got["a.bin", "raw", None if BIG[:2] != bytes.fromhex("8037") else "bigendian"] == crc(BIG) and got["g.zip", "raw", "byteswapped"] == crc(swapped(BIG, 2))
    none = F.lit(None).cast("string")
    jobs = files.select("collection", "file_name", none.alias("catalog"), F.col("path").alias("source_path"), F.concat(F.lit("x-"), "file_name").alias("target_name"), F.lit(1).alias("n_steps"),
                        F.lit(2).cast("long").alias("strip_bytes"), *[none.alias(c) for c in ("inner_name", "from_fmt", "to_fmt", "new_ext")], "content").where("file_name = 'a.bin'")
    assert [(r.bytes, r.error) for r in writer.write_exports(jobs, str(tmp_path / "out")).collect()] == [(len(BIG) - 2, None)]
    assert (tmp_path / "out" / "c" / "x-a.bin").read_bytes() == BIG[2:]


def test_streamed_across_blocks(spark, tmp_path, monkeypatch):
    content = bytes.fromhex("37804012") + bytes(range(256)) * 70_000  # more than two blocks
    path = tmp_path / "big"
    path.write_bytes(content)
    listed = spark.createDataFrame([("c", "big", str(path))], "collection string, file_name string, path string")
    got = {(r.kind, r.prefix, r.label and r.label[:4]): r.hash for r in streamed_variants(listed).collect()}
    assert got["raw", None, None] == crc(content)
    assert got["prefix", 8192, "Atar"] == crc(content[8192:])
    assert got["swap", None, "Byte"] == crc(swapped(content, 2)) and got["swap", None, "Litt"] == crc(swapped(content, 4))


def test_streamed_members_and_errors(spark, tmp_path):
    data = swapped(BIG, 2)
    with zipfile.ZipFile(tmp_path / "g.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "x" * 5000)
        z.writestr("g.v64", data)
    listed = spark.createDataFrame(
        [("c", "g.zip", str(tmp_path / "g.zip"), "g.v64"), ("c", "gone", str(tmp_path / "gone"), None), ("c", "bad.zip", str(tmp_path / "g.zip"), "none")],
        "collection string, file_name string, path string, member_name string")
    got = streamed_variants(listed).collect()
    good = {(r.kind, r.prefix): r for r in got if not r.error}
    assert good["raw", None].hash == crc(data) and good["raw", None].order_found == "byteswapped" and good["raw", None].size == len(data)
    assert crc(BIG) in {r.hash for r in got if r.kind == "swap"} and good["prefix", 64].zero_pct == 0
    assert sorted((r.file_name, r.error.split(":")[0], r.hash) for r in got if r.error) == [("bad.zip", "KeyError", None), ("gone", "FileNotFoundError", None)]


def test_embedded_digest(spark):
    def image(tag=b"MComprHD", version=5, digest=b"\x11" * 20, tail=40):
        return tag + (124).to_bytes(4, "big") + version.to_bytes(4, "big") + bytes(48) + digest + bytes(tail)

    data = [image(), image(tag=b"MComprXX"), image(version=4), image(digest=bytes(20)), image(tail=10)]
    got = [r.v for r in rows(spark, *data).select(embedded_sha1(F.col("content")).alias("v")).collect()]
    assert got == ["11" * 20, None, None, None, None]
