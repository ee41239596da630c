import json
import sqlite3
from datetime import datetime

import pytest

from curatrix.operators import codec, collection
from curatrix.sources import actions, database, files, library, settings


def pairs(spark, rows):
    return spark.createDataFrame(rows, "old string, new string")


def names(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if p.is_file() and not p.name.endswith(".crc")}


def test_names_change_places(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    out = actions.rename_all(spark, str(tmp_path), pairs(spark, [("a", "b"), ("b", "a")]))
    assert sorted(out.done) == [("a", "b"), ("b", "a")] and not out.skipped
    assert names(tmp_path) == {"a": "b", "b": "a"}


def test_a_taken_target_is_skipped(spark, tmp_path):
    for n in ("a.x", "b.x", "c.x 1"):
        (tmp_path / n).write_text(n)
    out = actions.rename_all(spark, str(tmp_path), pairs(spark, [("a.x", "b.x"), ("c.x 1", "a.x")]))
    assert ("a.x", "b.x") in out.skipped and len(out.skipped) + len(out.done) == 2
    assert sorted(names(tmp_path).values()) == ["a.x", "b.x", "c.x 1"]
    assert names(tmp_path)["b.x"] == "b.x"


def test_nothing_happens_if_a_source_is_gone_or_a_step_fails(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    with pytest.raises(FileNotFoundError):
        actions.rename_all(spark, str(tmp_path), pairs(spark, [("a", "z"), ("gone", "y")]))
    real, calls = actions.Folder.rename, []

    def failing(self, old, new):
        calls.append(old)
        if len(calls) == 4:
            raise OSError("held")
        real(self, old, new)

    monkeypatch.setattr(actions.Folder, "rename", failing)
    with pytest.raises(OSError, match="held"):
        actions.rename_all(spark, str(tmp_path), pairs(spark, [("a", "x"), ("b", "y")]))
    assert names(tmp_path) == {"a": "a", "b": "b"}


def test_moves(spark, tmp_path):
    for d in ("p", "q"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "s.mp3").write_text(d)
    plan = spark.createDataFrame([(str(tmp_path / d / "s.mp3"), "s.mp3") for d in "pq"], "path string, target string").coalesce(1)
    assert actions.move_all(spark, plan, str(tmp_path / "to")) == 2
    assert names(tmp_path / "to") == {"s.mp3": "p", "s (2).mp3": "q"}
    assert not names(tmp_path / "p")


def test_backup(spark, tmp_path):
    (tmp_path / "m.db").write_text("1")
    (tmp_path / "m.db-wal").write_text("2")
    name = actions.backup(spark, str(tmp_path / "m.db"), str(tmp_path / "b"), datetime(2024, 1, 2, 3, 4, 5))
    assert name == "m.db.20240102-030405.bak"
    assert names(tmp_path / "b") == {name: "1", name + "-wal": "2"}
    with pytest.raises(Exception):  # noqa: B017
        actions.backup(spark, str(tmp_path / "none.db"), str(tmp_path / "b"))


def test_retry():
    tries = []

    def action(fail, error):
        tries.append(1)
        if len(tries) <= fail:
            raise error
        return "done"

    assert actions.retry(lambda: action(2, OSError(32, "held")), (0, 0, 0)) == "done" and len(tries) == 3
    tries.clear()
    with pytest.raises(OSError):
        actions.retry(lambda: action(9, OSError(33, "held")), (0, 0, 0))
    assert len(tries) == 4
    tries.clear()
    with pytest.raises(OSError):
        actions.retry(lambda: action(9, OSError(2, "gone")), (0, 0, 0))
    assert len(tries) == 1


def test_tags_are_written_to_files(spark, tmp_path):
    (tmp_path / "A - T.mp3").write_bytes(b"\xff\xfbaudio")
    (tmp_path / "bad - x.wav").write_bytes(b"no wav at all")
    rows = files.list_files(spark, str(tmp_path), content=True)
    got = {r.path.rpartition("/")[2]: r.status for r in actions.write_contents(codec.tag_files(rows)).collect()}
    assert got == {"A - T.mp3": "ok", "bad - x.wav": "error"}
    assert codec.read_tags((tmp_path / "A - T.mp3").read_bytes()) == ("A", "T")
    assert [tuple(r) for r in files.tag_table(spark, str(tmp_path)).collect()] == [("A - T.mp3", "A", "T")]
    assert codec.tally(codec.tag_files(rows)).count() == 2


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    assert settings.load_settings(str(path)) == settings.Settings()
    path.write_text("{bad")
    assert settings.load_settings(str(path)) == settings.Settings()
    path.write_text(json.dumps({"prefer_tags": False, "other": 1}))
    assert settings.load_settings(str(path)).naming().source == "filename"


def test_collection_file(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE djmdContent (ID, FolderPath, FileNameL, FileNameS, Title, ArtistID, created_at, DJPlayCount INT, Rating INT, Commnt); CREATE TABLE djmdCue (ID, ContentID); CREATE TABLE djmdSongPlaylist (ID, PlaylistID, ContentID); CREATE TABLE djmdArtist (ID, Name); INSERT INTO djmdContent VALUES ('1', '/x/A - B.mp3', 'A - B.mp3', NULL, NULL, NULL, '2020', 3, 0, NULL); INSERT INTO djmdCue VALUES ('q', '1')")
    tables = database.read_collection(spark, path)
    entry = collection.load_entries(tables["content"], tables["cues"], tables["playlists"]).first()
    assert (entry.id, entry.ext, entry.plays, entry.cue_ids, entry.playlist_rows) == ("1", ".mp3", 3, ["q"], [])
    assert database.locate(None, ("/none", path)) == path and database.locate("/none") is None


def test_health_scan_of_a_folder(spark, tmp_path):
    folder = tmp_path / "Crate"
    folder.mkdir()
    wave = lambda text: b"RIFF\x14\0\0\0WAVEdata" + len(text).to_bytes(4, "little") + text
    (folder / "Orla - Mist.wav").write_bytes(wave(b"same"))
    (folder / "Orla - Mist copy.wav").write_bytes(wave(b"same"))
    (folder / "Zoe, Abel - Rain.wav").write_bytes(wave(b"else"))
    (folder / "hum.wav").write_bytes(wave(b"humming"))
    (folder / "tagged.wav").write_bytes(codec.write_wav(wave(b"tagged!!"), "Orla", "Mist"))
    plain = settings.Settings(prefer_tags=False)
    found = library.health_scan(spark, str(folder), plain)
    report = found.report.first()
    assert (found.audio_files, report.rename_issues, report.manual_review) == (5, 1, 2)
    assert (report.file_groups, report.file_extras, report.score) == (1, 1, 100)
    assert [r.code for r in found.issues.orderBy("place").collect()] == ["rename-issues", "manual-review", "file-duplicates", "collection-not-configured"]
    # With tags, the tagged file gets its name from them; its song's other file is an extra already.
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE djmdContent (ID, FolderPath, FileNameL, FileNameS, Title, ArtistID, created_at, DJPlayCount INT, Rating INT, Commnt); CREATE TABLE djmdCue (ID, ContentID); CREATE TABLE djmdSongPlaylist (ID, PlaylistID, ContentID); CREATE TABLE djmdArtist (ID, Name)")
        for i, p in enumerate([folder / "hum.wav", folder / "gone.wav", folder / "GONE.wav", folder / "lost.wav", tmp_path / "other" / "x.wav"]):
            db.execute("INSERT INTO djmdContent (ID, FolderPath) VALUES (?, ?)", (str(i), str(p)))
    found = library.health_scan(spark, str(folder), settings.Settings(master_db="/nowhere.db"), candidates=(path,))
    report = found.report.first()
    assert (report.rename_issues, report.manual_review, report.file_groups, report.file_extras) == (2, 1, 1, 1)
    assert (report.missing_files, report.collection_groups, report.collection_extras) == (3, 1, 1) and found.database == path
    assert found.missing_sample == tuple(str(folder / n) for n in ("gone.wav", "GONE.wav", "lost.wav"))
    assert "missing-files" in [r.code for r in found.issues.collect()]
    # A running application, a file that is no database, and a configured one that is gone.
    assert [r.code for r in library.health_scan(spark, str(folder), plain, running=True, candidates=(path,)).issues.orderBy("place").collect()][-1] == "collection-running"
    (tmp_path / "bad.db").write_bytes(b"no database at all" * 100)
    bad = library.health_scan(spark, str(folder), settings.Settings(master_db=str(tmp_path / "bad.db")))
    assert [r.code for r in bad.issues.orderBy("place").collect()][-1] == "collection-inspection" and bad.report.first().missing_files == 0
    gone = library.health_scan(spark, str(folder), settings.Settings(master_db="/nowhere.db", prefer_tags=False)).report.first()
    assert gone.score == 95


def test_databases_are_found(tmp_path):
    db, options = tmp_path / "m.db", tmp_path / "options.json"
    db.write_bytes(b"")
    options.write_text(json.dumps({"options": [["x", 1], ["db-path", str(db)]]}))
    assert database.locate("/none", (), ("/no.json", str(options))) == str(db)
    for text in ("{", "[]", '{"options": [["db-path"]]}', '{"options": [["y", "z"]]}'):
        options.write_text(text)
        assert database.locate(None, (), (str(options),)) is None


def test_files_that_are_there(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("x")
    paths = [str(tmp_path / "a b.txt"), f"file:{tmp_path}/a b.txt", f"file://{tmp_path}/a b.txt", str(tmp_path), str(tmp_path / "c"), None, "odd://x/y"]
    rows = files.existing(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted(r.path for r in rows) == sorted(paths[:3])


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from curatrix import lineage

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False, "isEmpty": lambda self: True})()})()})()

    session = type("S", (), {"sparkContext": Context(), "conf": type("F", (), {"get": lambda self, *a: None})()})()
    with pytest.raises(ValueError, match="checkpoint"):
        lineage.shared_dir(session)
