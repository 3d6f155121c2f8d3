"""The composed runs over real catalogues and files."""

import os
import zipfile

import pytest
from test_files import COLLECTION, GONE, HELD, catalog_xml, crc

from shelfmark.plans import runs

BODY = bytes([0xAB]) * 1024


@pytest.fixture
def shelf(spark, tmp_path):
    cats, files = tmp_path / "catalogs", tmp_path / "files" / COLLECTION
    cats.mkdir()
    files.mkdir(parents=True)
    sets = [(n, len(x), crc(x)) for n, x in HELD.items()] + [(n, 0, "00000000") for n in GONE] + [("Hidden Game (USA)", len(BODY), crc(BODY))]
    (cats / "list.dat").write_text(catalog_xml(COLLECTION + " (Parent-Clone)", sets))
    (cats / "cut.dat").write_text(catalog_xml(COLLECTION, sets)[:300])
    for n, x in HELD.items():
        with zipfile.ZipFile(files / f"{n}.zip", "w") as z:
            z.writestr(f"{n}.sfc", x)
    with zipfile.ZipFile(files / "odd name.zip", "w") as z:
        z.writestr("inner.smc", bytes(512) + BODY)
        z.writestr("readme.txt", "x")
    (files / "stranger.sfc").write_bytes(b"nothing listed")
    (files / "broken.zip").write_bytes(b"not a zip")
    return runs.open_shelf(spark, str(cats), str(files))


def test_scan(shelf):
    sets, unmatched = runs.scan(shelf)
    assert {r.set_name: r.status for r in sets.collect()} == {**dict.fromkeys(HELD, "ok"), **dict.fromkeys([*GONE, "Hidden Game (USA)"], "missing")}
    assert {r.file_name for r in unmatched.collect()} == {"odd name.zip", "stranger.sfc", "broken.zip"}
    assert sorted(os.path.basename(r.path) for r in shelf.problems.collect()) == ["cut.dat"]


def test_check_names(shelf):
    ratings, rows = runs.check_names(shelf)
    assert [r.rating for r in ratings.collect()] == ["green"]
    by_set = {r.set_name: r.status for r in rows.collect()}
    assert all(by_set[n] == "unverified" for n in HELD) and all(by_set[n] == "missing" for n in GONE)


def test_analyse_and_export(spark, shelf, tmp_path):
    best = {r.file_name: r for r in runs.analyse(shelf).collect()}
    assert best["odd name.zip"].set_name == "Hidden Game (USA)" and best["odd name.zip"].status == "matched"
    assert {f for f, r in best.items() if r.status == "matched"} == {f"{n}.zip" for n in HELD} | {"odd name.zip"}
    manifest = runs.export(shelf, runs.analyse(shelf), str(tmp_path / "out")).collect()
    assert sorted(r.target_name for r in manifest) == sorted([f"{n}.zip" for n in HELD] + ["Hidden Game (USA).zip"]) and not any(r.error for r in manifest)
    with zipfile.ZipFile(tmp_path / "out" / COLLECTION / "Hidden Game (USA).zip") as z:
        assert z.namelist() == ["Hidden Game (USA).sfc"] and z.read("Hidden Game (USA).sfc") == BODY
