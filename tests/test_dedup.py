import random
from collections import defaultdict

from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators import dedup, ranking
from curatrix.sources import files as source

SCHEMA = "ord long, path string, artist string, title string, ext string, dur double, size long, hash string, key string"


def model(rows, mode):
    """One pass after the other, as a person would do it."""
    best = lambda r: (-t.QUALITY.get(r["ext"], 0), -(r["dur"] or 0), -r["size"], r["ord"])
    out, seen = [], set()
    if mode != "song":
        sizes = defaultdict(lambda: defaultdict(list))
        for r in rows:
            sizes[r["size"]][r["hash"]].append(r)
        for by_hash in sizes.values():
            out += [("exact", sorted(g, key=best)) for g in by_hash.values() if len(g) > 1]
        seen = {r["ord"] for _, g in out for r in g[1:]}
    if mode != "exact":
        keys = defaultdict(list)
        for r in rows:
            if r["title"]:
                keys[r["key"]].append(r)
        for g in keys.values():
            g = sorted(g, key=best)
            fresh = [r for r in g[1:] if r["ord"] not in seen]
            if fresh:
                out.append(("same-song", [g[0], *fresh]))
    return [(i, kind, "duplicate" if k else "keep", r["ord"]) for i, (kind, g) in enumerate(out, 1) for k, r in enumerate(g)]


def test_groups_are_those_of_one_pass_after_the_other(spark):
    rng = random.Random(3)
    for mode in ("both", "exact", "song"):
        rows = []
        for i in range(40):
            size = rng.randint(1, 4)
            rows.append({"ord": i, "path": f"/{i}", "artist": "", "title": rng.choice(["", "x", "y"]), "ext": rng.choice([".wav", ".mp3", ".txt"]), "dur": rng.choice([None, 1.0, 2.0]), "size": size, "hash": f"{size}{rng.randint(0, 2)}", "key": str(rng.randint(0, 9))})
        found = dedup.duplicates(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), mode)
        assert sorted((r.group, r.kind, r.role, r.ord) for r in found.collect()) == sorted(model(rows, mode))


def test_no_files(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = dedup.duplicates(empty)
    assert found.count() == 0
    assert dedup.summary(found).first().asDict() == {"groups": 0, "extras": 0}


def test_hash_strategies_agree(spark):
    same = b"p" * 200_000
    rows = [(0, len(same), same), (1, len(same), same), (2, len(same), same[:-1] + b"q"), (3, 5, b"tiny!"), (4, 5, b"tiny?")]
    files = spark.createDataFrame(rows, "ord long, size long, content binary").withColumn("ext", F.lit(".wav")).withColumn("dur", F.lit(None).cast("double"))
    for strategy in (dedup.HashStrategy(), dedup.HashStrategy("sha1"), dedup.HashStrategy(prefix_gate=True)):
        groups = dedup.exact_groups(dedup.with_hashes(files, strategy))
        assert sorted(r.ord for r in groups.collect()) == [0, 1]
    assert dedup.bytes_hashed(files).first()[0] == 3 * len(same) + 10


def test_moves_find_free_names(spark):
    extras = spark.createDataFrame([(1, "/a/x.mp3"), (2, "/b/x.mp3"), (3, "/c/x (2).mp3"), (4, "/d/y.mp3"), (5, "/e/.mp3")], "ord long, path string")
    occupied = spark.createDataFrame([("x.mp3",), ("x (3).mp3",)], "name string")
    got = {r.ord: r.target for r in dedup.move_plan(extras, occupied).collect()}
    assert got == {1: "x (2).mp3", 2: "x (4).mp3", 3: "x (2) (2).mp3", 4: "y.mp3", 5: ".mp3"}


def test_selection(spark):
    rows = spark.createDataFrame([(1, "keep", 1), (1, "duplicate", 2), (1, "duplicate", 3)], "group long, role string, ord long")
    chosen = spark.createDataFrame([(1,), (3,)], "ord long")
    assert [r.ord for r in dedup.selected(rows, chosen).collect()] == [3]


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [r.n for r in ranking.number_rows(df, ["x"], "n").orderBy("x").collect()]
    assert got == list(range(1, 1001))


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"b.wav": b"1", "A - T.mp3": b"22", "note.txt": b"", "sub/A - T.FLAC": b"333", "a.aifc": b"4", "c d.ogg": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = source.scan(spark, str(tmp_path), recursive=True).orderBy("ord").collect()
    assert [(r.ord, r.name, r.artist, r.title, r.ext, r.size) for r in rows] == [(1, "A - T.mp3", "A", "T", ".mp3", 2), (2, "a.aifc", "", "a", ".aifc", 1), (3, "b.wav", "", "b", ".wav", 1), (4, "c d.ogg", "", "c d", ".ogg", 0), (5, "A - T.FLAC", "A", "T", ".flac", 3)]
    assert {r.name for r in source.list_files(spark, str(tmp_path), extensions=t.NAME_EXTENSIONS).collect()} == {"A - T.mp3", "b.wav", "c d.ogg"}
    assert source.file_inventory(spark, str(tmp_path)).count() == 6
