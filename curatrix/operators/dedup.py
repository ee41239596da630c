"""Exact and same-item duplicates of files, with a deterministic choice of which to keep.

Groups are aggregates with a keeper in each, so a group of any size is a row until its members are
looked up again; only members of groups with more than one member are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import native
from curatrix.functions import text as t
from curatrix.lineage import materialize
from curatrix.operators.ranking import number_rows, number_within

PREFIX_BYTES = 64 << 10
#: Pairs of a size and a prefix's hash, 100 bytes or so each, that may be broadcast.
GATE_KEYS = 500_000
#: Rows of one name that a window may hold.
HOT_NAMES = 1_000_000


@dataclass(frozen=True)
class HashStrategy:
    """How equal contents are told: results are the same for all choices."""

    algorithm: str = "sha2"
    prefix_gate: bool = False


def content_hash(content: Column, algorithm: str = "sha2") -> Column:
    return F.sha1(content) if algorithm == "sha1" else F.sha2(content, 256)


def prefix_hash(content: Column) -> Column:
    """Of the first 64 KiB; marked, so that it equals no hash of a whole content."""
    return F.concat(F.lit("prefix:"), F.sha2(F.substring(content, 1, PREFIX_BYTES), 256))


def keeper_order(ext: Column, dur: Column, size: Column, ord_: Column) -> Column:
    """The least is kept: best quality, then longest, then largest, then first."""
    return F.struct((-t.quality_rank(ext)).alias("a"), (-F.coalesce(dur, F.lit(0.0))).alias("b"), (-size).alias("c"), ord_.alias("ord"))


def _recurring(files: DataFrame) -> DataFrame:
    """``size``, ``prefix`` of files that share both with another one."""
    pairs = files.select("size", prefix_hash(F.col("content")).alias("prefix"))
    return pairs.groupBy("size", "prefix").count().where("count > 1").select("size", "prefix", F.lit(True).alias("recurs"))


def with_hashes(files: DataFrame, strategy: HashStrategy = HashStrategy()) -> DataFrame:  # noqa: B008
    """``files`` (with ``content``) with ``hash`` in its place: contents never leave the scan's tasks.

    With the gate, only files whose size and prefix recur have a hash, and others a null. The recurring
    pairs are broadcast if they are GATE_KEYS at most, so that others aren't even hashed; beyond that
    all are hashed where they are read, and hashes of others dropped by a join without contents.
    """
    whole = content_hash(F.col("content"), strategy.algorithm)
    if not strategy.prefix_gate:
        return files.withColumn("hash", whole).drop("content")
    columns = [*[c for c in files.columns if c != "content"], "hash"]
    twice = materialize(_recurring(files), "gate")
    marked = files.withColumn("prefix", prefix_hash(F.col("content")))
    if twice.count() <= GATE_KEYS:
        return marked.join(F.broadcast(twice), ["size", "prefix"], "left").withColumn("hash", F.when(F.col("recurs"), whole)).select(*columns)
    hashed = marked.withColumn("hash", whole).drop("content")
    return hashed.join(twice, ["size", "prefix"], "left").withColumn("hash", F.when(F.col("recurs"), F.col("hash"))).select(*columns)


def bytes_hashed(files: DataFrame, strategy: HashStrategy = HashStrategy()) -> DataFrame:  # noqa: B008
    """One row: how many bytes of files that share their size a strategy hashes.

    Without the gate these are all their bytes; with it, their first 64 KiB, and once more all bytes of
    those whose prefix recurs too.
    """
    shared = files.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not strategy.prefix_gate:
        return shared.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).cast("long").alias("bytes"))
    first = shared.select((F.least("size", F.lit(PREFIX_BYTES)) * F.col("n")).alias("read"))
    pairs = files.select("size", prefix_hash(F.col("content")).alias("prefix")).groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return first.unionAll(pairs.select((F.col("size") * F.col("n")).alias("read"))).agg(F.coalesce(F.sum("read"), F.lit(0)).cast("long").alias("bytes"))


def _heads(files: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one file: their keys, first file (g2) and keeper."""
    order = keeper_order(F.col("ext"), F.col("dur"), F.col("size"), F.col("ord"))
    heads = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("g2"), F.min(order).alias("best")).where("n > 1")
    return heads.select(*keys, "g2", F.col("best.ord").alias("keeper"))


def _exact_heads(files: DataFrame) -> DataFrame:
    """Groups come in the order of the first file of their size (g1), then of their own."""
    first = files.groupBy("size").agg(F.min("ord").alias("g1"))
    return _heads(files.where("hash IS NOT NULL"), ["size", "hash"]).join(first, "size").withColumn("pass", F.lit(1))


def _song_heads(files: DataFrame) -> DataFrame:
    return _heads(files.where("title <> ''"), ["key"]).withColumn("g1", F.col("g2")).withColumn("pass", F.lit(2))


# Heads are tables, so that joins with them shuffle two inputs and a hot group is split.


def exact_groups(files: DataFrame) -> DataFrame:
    """Files (with ``hash``) of equal size and content, with their group: pass, g1, g2, keeper."""
    return files.join(materialize(_exact_heads(files), "heads"), ["size", "hash"])


def song_groups(files: DataFrame) -> DataFrame:
    """Files with a title and one normalized key, with their group."""
    return files.where("title <> ''").join(materialize(_song_heads(files), "heads"), "key")


def members(files: DataFrame, mode: str = "both", strict: bool = False) -> DataFrame:
    """Members of all groups: pass, g1, g2 (which tell the group), keeper, and the files' columns.

    ``files``: ord, path, artist, title, ext, dur, size, hash, key. Exact groups come first, then
    same-item ones without the extras of the first pass; a group left without extras goes. A file may
    be an extra in the first pass and a keeper in the second, unless ``strict``.
    """
    files = materialize(files.drop("content"), "files")
    columns = ["pass", "g1", "g2", "keeper", *[c for c in files.columns if c not in ("hash", "key")]]
    if mode == "exact":
        return exact_groups(files).select(*columns)
    if mode == "song":
        return song_groups(files).select(*columns)
    if strict:
        exact = exact_groups(files)
        songs = song_groups(files.join(exact.where("ord <> keeper").select("ord"), "ord", "left_anti"))
    else:
        heads = materialize(_exact_heads(files).unionByName(_song_heads(files), allowMissingColumns=True), "heads")
        exact = files.join(heads.where("pass = 1").drop("key"), ["size", "hash"])
        songs = files.where("title <> ''").join(heads.where("pass = 2").drop("size", "hash"), "key")
    seen = exact.where("ord <> keeper").select("ord")
    fresh = songs.where("ord <> keeper").join(seen, "ord", "left_anti")
    kept = songs.where("ord = keeper").join(fresh.select("g1").distinct(), "g1", "left_semi")
    return exact.select(*columns).unionByName(kept.select(*columns)).unionByName(fresh.select(*columns))


def duplicates(files: DataFrame, mode: str = "both", strict: bool = False) -> DataFrame:
    """One row per member of each group: group, kind, role, and the file's columns (see ``members``)."""
    rows = materialize(members(files, mode, strict), "members")
    heads = number_rows(rows.select("pass", "g1", "g2").distinct(), ["pass", "g1", "g2"], "group")
    out = rows.join(heads, ["pass", "g1", "g2"])
    kind = F.when(F.col("pass") == 1, "exact").otherwise("same-song")
    role = F.when(F.col("ord") == F.col("keeper"), "keep").otherwise("duplicate")
    return out.select("group", kind.alias("kind"), role.alias("role"), *[c for c in rows.columns if c not in ("pass", "g1", "g2", "keeper")])


def report(rows: DataFrame) -> DataFrame:
    """The report's columns in its order: by group, the kept one first, then as they were ranked."""
    order = keeper_order(F.col("ext"), F.col("dur"), F.col("size"), F.col("ord"))
    ordered = rows.orderBy("group", F.col("role") != "keep", order)
    return ordered.select("group", "kind", "role", F.col("path").alias("file"), "artist", "title", "ext", F.col("size").alias("size_bytes"))


def summary(rows: DataFrame) -> DataFrame:
    """One row, groups and extras, of ``duplicates`` or, cheaper, of ``members``."""
    if "group" in rows.columns:
        return rows.agg(F.count_distinct("group").alias("groups"), F.count_if(F.col("role") != "keep").alias("extras"))
    return rows.agg(F.count_distinct("pass", "g1", "g2").alias("groups"), F.count_if(F.col("ord") != F.col("keeper")).alias("extras"))


def selected(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The extras that are in the selection (``ord``)."""
    return rows.where("role <> 'keep'").join(chosen.select("ord"), "ord", "left_semi")


def move_plan(extras: DataFrame, occupied: DataFrame) -> DataFrame:
    """``ord, path, target``: names in one folder; a taken one gets `` (2)``, `` (3)``, until it's free.

    ``occupied`` has the folder's names (``name``). Candidates of a name are its stem with a number, and
    a family is all names that could meet there. Where all names of a family are one, its rows are
    numbered. Where some already have a number, the family is settled in order, as one move after the
    other would be, and the names it has taken are held.
    """
    name = t.split_path(F.col("path"))[1]
    wanted = extras.select("ord", "path", name.alias("name"))
    both = wanted.unionByName(occupied.select("name").distinct(), allowMissingColumns=True)
    stem = F.regexp_replace(t.splitext(F.col("name"))[0], r"(?: \(\d+\))+\z", "")
    both = both.withColumn("family", F.concat(stem, F.lit("\x00"), t.splitext(F.col("name"))[1]))
    kinds = both.groupBy("family").agg((F.min("name") == F.max("name")).alias("alike"), F.count_if(F.col("ord").isNull()).alias("taken"))
    both = materialize(both.join(materialize(kinds, "families"), "family"), "names")
    alike = number_within(both.where("alike AND ord IS NOT NULL"), "family", ["ord"], "n", HOT_NAMES).withColumn("n", F.col("n") + F.col("taken"))
    root, ext = t.splitext(F.col("name"))
    target = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(root, F.lit(" ("), F.col("n").cast("string"), F.lit(")"), ext))
    parts = int(extras.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = both.where("NOT alike").select("ord", "path", "name", "family")
    sorted_ = rest.repartition(parts, "family").sortWithinPartitions("family", F.col("ord").isNotNull(), "ord")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, last = None, set(), {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.family != now:
                    now, taken, last = r.family, set(), {}
                if pd.isna(r.ord):
                    taken.add(r.name)
                    continue
                target, n = r.name, last.get(r.name, 1)
                root, ext = native.splitext(r.name)
                while target in taken:
                    n += 1
                    target = f"{root} ({n}){ext}"
                last[r.name] = n
                taken.add(target)
                out.append((int(r.ord), r.path, target))
            yield pd.DataFrame(out, columns=["ord", "path", "target"])

    return alike.select("ord", "path", target.alias("target")).unionByName(sorted_.mapInPandas(settle, "ord long, path string, target string"))
