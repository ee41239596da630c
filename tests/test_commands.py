import sqlite3

import pytest

from curatrix.__main__ import main, parser
from curatrix.operators import codec
from curatrix.sources import progress


def wave(text):
    return b"RIFF" + (12 + len(text)).to_bytes(4, "little") + b"WAVEdata" + len(text).to_bytes(4, "little") + text


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "crate"
    made.mkdir()
    for name, text in {"Vik, Ane - Moss.wav": b"mossmoss", "Ane, Vik - Moss (2).wav": b"mossmoss", "03_Oda - Elk.wav": b"elk!", "noise.wav": b"nnnn"}.items():
        (made / name).write_bytes(wave(text))
    return made


def names(folder):
    return sorted(p.name for p in folder.iterdir() if p.suffix == ".wav")


def test_names_are_planned_then_changed_and_back(spark, folder):
    before = names(folder)
    planned = main(["names", str(folder), "--source", "filename"], spark)
    assert (planned["total"], planned["to_rename"], planned["manual"]) == (4, 2, 1) and names(folder) == before
    made = main(["names", str(folder), "--source", "filename", "--apply"], spark)
    assert made["renamed"] == 2 and "Oda - Elk.wav" in names(folder) and "Ane, Vik - Moss.wav" in names(folder)
    assert (folder / "rename_rollback.csv").read_text("utf-8-sig").startswith("current_name,restore_to")


def test_tags(spark, folder):
    assert main(["tags", str(folder), "--dry-run"], spark) == {"ok": 4}
    assert codec.read_tags((folder / "03_Oda - Elk.wav").read_bytes()) is None
    assert main(["tags", str(folder)], spark) == {"ok": 4}
    assert codec.read_tags((folder / "03_Oda - Elk.wav").read_bytes()) == ("03_Oda", "Elk")


@pytest.mark.parametrize("how", ["report", "move", "delete"])
def test_duplicates(spark, folder, tmp_path, how):
    options = {"report": [], "move": ["--move", str(tmp_path / "extra")], "delete": ["--delete"]}[how]
    out = main(["duplicates", str(folder), "--mode", "exact", *options], spark)
    assert (out["groups"], out["extras"]) == (1, 1) and len(names(folder)) == (4 if how == "report" else 3)
    assert len((folder / "duplicates_report.csv").read_text("utf-8-sig").splitlines()) == 3
    if how == "move":
        assert out["moved"] == 1 and names(tmp_path / "extra") == ["Vik, Ane - Moss.wav"]
    if how == "delete":
        assert out["deleted"] == 1


def test_collections(spark, folder, tmp_path):
    db = str(tmp_path / "c.db")
    with sqlite3.connect(db) as con:
        con.executescript("CREATE TABLE djmdContent (ID, FolderPath, FileNameL, FileNameS, Title, ArtistID, created_at, DJPlayCount INT, Rating INT, Commnt); CREATE TABLE djmdCue (ID, ContentID); CREATE TABLE djmdSongPlaylist (ID, PlaylistID, ContentID); CREATE TABLE djmdArtist (ID, Name)")
        con.executemany("INSERT INTO djmdContent (ID, FolderPath, Title) VALUES (?, ?, 'T')", [("1", f"{folder}/old.wav"), ("2", f"{folder}/OLD.wav"), ("3", f"{folder}/noise.wav")])
    (tmp_path / "map.csv").write_text("OLD name,NEW name\nold.wav,03_Oda - Elk.wav\n")
    out = main(["relink", "--db", db, "--map", str(tmp_path / "map.csv"), "--out", str(tmp_path / "new"), "--backup-dir", str(tmp_path / "saved"), "--set-title"], spark)
    assert out["entries"] == 1 and list((tmp_path / "saved").glob("c.db.*.bak"))
    rows = {r.id: r for r in spark.read.parquet(str(tmp_path / "new" / "content")).collect()}
    artist = spark.read.parquet(str(tmp_path / "new" / "artists")).first()
    assert (rows["1"].path, rows["1"].title, rows["1"].artist_id) == (f"{folder}/03_Oda - Elk.wav", "Elk", artist.id) and artist.name == "03_Oda" and rows["2"].title == "T"
    out = main(["merge", "--db", db, "--out", str(tmp_path / "merged"), "--report", str(tmp_path / "report.csv")], spark)
    assert (out["groups"], out["extras"]) == (1, 1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "merged" / "content")).collect()) == ["1", "3"]


def test_health(spark, folder, capsys):
    out = main(["health", str(folder)], spark)
    assert out["files"] == 4 and out["score"] == 100 and "file-duplicates" in out["issues"]
    assert "label: Healthy" in capsys.readouterr().out


def test_commands_need_what_they_need():
    for bad in ([], ["names"], ["relink", "--db", "x"], ["names", "x", "--source", "else"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_progress(spark):
    seen = []
    with progress.watch(spark, lambda done, total: seen.append((done, total)), every=0.01):
        spark.range(4_000_000, numPartitions=8).selectExpr("sum(pmod(xxhash64(id), 1000))").collect()
    assert seen[-1] == (1, 1) and all(0 <= done <= total for done, total in seen)
