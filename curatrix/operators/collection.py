"""Collection tables: entries with their children, duplicates, merges, relinks, dangling paths.

Changes are new versions of tables: a left join with the plan and a projection, or an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.lineage import materialize
from curatrix.operators.ranking import number_rows

STREAM_PREFIX = "spotify:"  # fixed value


def load_entries(content: DataFrame, cues: DataFrame, playlists: DataFrame, folder: str = "") -> DataFrame:
    """Entries with lists of their children.

    ``content``: id, path, title, created, plays, rating, comment. ``cues``: id, content_id.
    ``playlists``: id, playlist_id, content_id. Streamed and pathless entries are left out; ``folder``
    keeps paths that contain it, case aside.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "path", "title", "created", "comment")}
    number = {c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("plays", "rating")}
    rows = content.select(*text.values(), *number.values())
    rows = rows.where((F.col("path") != "") & ~F.col("path").startswith(STREAM_PREFIX))
    if folder:
        rows = rows.where(F.contains(F.lower("path"), F.lower(F.lit(folder))))
    by_cue = cues.groupBy(F.col("content_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("cue_ids"))
    by_list = playlists.groupBy(F.col("content_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("row_id"), F.col("playlist_id").cast("string").alias("playlist_id")))).alias("playlist_rows"))
    rows = rows.join(by_cue, "id", "left").join(by_list, "id", "left")
    rows = rows.withColumn("cue_ids", F.coalesce("cue_ids", F.array().cast("array<string>"))).withColumn("playlist_rows", F.coalesce("playlist_rows", F.array().cast("array<struct<row_id:string,playlist_id:string>>")))
    return rows.withColumn("ext", t.ext_of(F.col("path")))


def info_score() -> Column:
    """How much a user has put into an entry."""
    return (3 * F.size("cue_ids") + 2 * F.size("playlist_rows") + F.col("plays") + (F.col("rating") != 0).cast("int") + (F.col("comment") != "").cast("int")).cast("long")


def _best() -> Column:
    return F.struct((-t.quality_rank(F.col("ext"))).alias("a"), (-info_score()).alias("b"), F.col("created").alias("c"), F.col("id").alias("id"))


def _heads(entries: DataFrame, key: str, kind: int) -> DataFrame:
    """Groups of one key: its first id and its keeper. Songs are groups of two paths at least."""
    heads = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path_key").alias("paths"), F.min("id").alias("first"), F.min(_best()).alias("best"))
    good = (F.col("n") > 1) & (F.lit(kind == 1) | (F.col("paths") > 1))
    return heads.where(good).select(key, F.lit(kind).alias("pass"), "first", F.col("best.id").alias("keeper"))


def members(entries: DataFrame) -> DataFrame:
    """Members of all groups: pass and first (which tell the group), keeper, and the entry's columns.

    Entries of one path, case and slashes aside, are one file; of the rest, those of one normalized
    file name are one song.
    """
    artist, title = t.parse_name(t.split_path(F.col("path"))[1])
    keyed = entries.withColumn("path_key", t.path_key(F.col("path"))).withColumn("song_artist", artist).withColumn("song_title", title)
    keyed = materialize(keyed.withColumn("song_key", t.norm_key(F.col("song_artist"), F.col("song_title"))).drop("song_artist"), "entries")
    one_file = _heads(keyed, "path_key", 1)
    rest = keyed.where("song_title <> ''").join(one_file.select("path_key"), "path_key", "left_anti")
    # A table, so that joins with it shuffle two inputs and a hot group is split.
    heads = materialize(one_file.unionByName(_heads(rest, "song_key", 2), allowMissingColumns=True), "heads")
    files, songs = heads.where("pass = 1").drop("song_key"), heads.where("pass = 2").drop("path_key")
    rest = keyed.where("song_title <> ''").join(files.select("path_key"), "path_key", "left_anti")
    return keyed.join(files, "path_key").unionByName(rest.join(songs, "song_key")).select("pass", "first", "keeper", *entries.columns)


def summary(rows: DataFrame) -> DataFrame:
    """One row, groups and extras, of ``members``."""
    return rows.agg(F.count_distinct("pass", "first").alias("groups"), F.count_if(F.col("id") != F.col("keeper")).alias("extras"))


def duplicates(entries: DataFrame) -> DataFrame:
    """One row per member of each group: group, kind, role, keeper, order (least: keeper) and the entry.

    Groups (see ``members``) are numbered by kind and then by their first id.
    """
    rows = materialize(members(entries), "members")
    heads = number_rows(rows.select("pass", "first").distinct(), ["pass", "first"], "group")
    out = rows.join(heads, ["pass", "first"])
    kind = F.when(F.col("pass") == 1, "same-file").otherwise("same-song")
    role = F.when(F.col("id") == F.col("keeper"), "keep").otherwise("remove")
    return out.select("group", kind.alias("kind"), role.alias("role"), "keeper", _best().alias("order"), *entries.columns)


def report(rows: DataFrame) -> DataFrame:
    ordered = rows.orderBy("group", F.col("role") != "keep", "order")
    return ordered.select("group", "kind", "role", F.col("id").alias("entry_id"), "path", F.size("cue_ids").alias("cues"), F.size("playlist_rows").alias("playlists"), "plays", "rating", "created")


def merge(groups: DataFrame, content: DataFrame, cues: DataFrame, playlists: DataFrame) -> dict[str, DataFrame]:
    """New versions of ``content``, ``cues`` and ``playlists`` with extras merged into keepers.

    An extra's playlist row goes to the keeper if the playlist isn't there yet, the first one in order;
    its cues go to the keeper if that has none, those of the first extra with any. All other children
    of extras are deleted, and so are extras. Other tables are left as they are.
    """
    order = F.struct((F.col("role") != "keep").alias("extra"), "order")
    member = groups.select(F.col("id").alias("content_id"), "keeper", order.alias("o"), F.col("role"))
    extra = member.where("role <> 'keep'")
    mine = playlists.withColumn("content_id", F.col("content_id").cast("string")).join(member, "content_id", "left")
    row_order = F.struct("o", F.col("id"))
    first = mine.where("keeper IS NOT NULL").groupBy("keeper", "playlist_id").agg(F.min(row_order).alias("first"))
    kept = mine.where("keeper IS NOT NULL").join(first, ["keeper", "playlist_id"]).where((F.col("role") == "keep") | (row_order == F.col("first")))
    lists = kept.withColumn("content_id", F.col("keeper")).select(*playlists.columns).unionByName(mine.where("keeper IS NULL").select(*playlists.columns))
    cued = cues.withColumn("content_id", F.col("content_id").cast("string")).join(member, "content_id", "left")
    donor = cued.where("keeper IS NOT NULL").groupBy("keeper").agg(F.min("o").alias("donor"))
    given = cued.where("keeper IS NOT NULL").join(donor, "keeper").where("o = donor").withColumn("content_id", F.col("keeper"))
    new_cues = given.select(*cues.columns).unionByName(cued.where("keeper IS NULL").select(*cues.columns))
    new_content = content.join(extra.select(F.col("content_id").alias("__id")), F.col("id").cast("string") == F.col("__id"), "left_anti")
    return {"content": new_content, "cues": new_cues, "playlists": lists}


def last_mapping(mapping: DataFrame) -> DataFrame:
    """``old, new`` (and ``ord``): of rows with one old name the last counts."""
    return mapping.groupBy("old").agg(F.max_by("new", "ord").alias("new"))


def relink_plan(content: DataFrame, mapping: DataFrame, folder: str = "") -> DataFrame:
    """content_id, old_name, new_name, new_path, title, artist: entries whose file has a new name.

    ``content``: id, path, file_name. The file's folder doesn't matter, but for ``folder``, which the
    path must contain, case and all.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "path", "file_name")}
    rows = content.select(*text.values())
    if folder:
        rows = rows.where(F.contains("path", F.lit(folder)))
    directory, base = t.split_path(F.col("path"))
    rows = rows.withColumn("__dir", F.translate(directory, "\\", "/")).withColumn("old_name", t.first_nonempty(base, F.col("file_name")))
    found = rows.join(last_mapping(mapping).withColumnRenamed("old", "old_name"), "old_name").where("new <> old_name")
    artist, title = t.parse_name(F.col("new"))
    return found.select(F.col("id").alias("content_id"), "old_name", F.col("new").alias("new_name"), F.concat("__dir", F.lit("/"), F.col("new")).alias("new_path"), title.alias("title"), artist.alias("artist"))


def with_artists(artists: DataFrame, plan: DataFrame) -> DataFrame:
    """``artists`` (id, name) with a row for each of the plan's artists that is missing; ids follow names."""
    wanted = plan.where("artist <> ''").select(F.col("artist").alias("name")).distinct().join(artists.select("name"), "name", "left_anti")
    return artists.select("id", "name").unionByName(wanted.select(F.shiftrightunsigned(F.xxhash64("name"), 1).cast("string").alias("id"), "name"))


def apply_relink(content: DataFrame, plan: DataFrame, set_title: bool = True, refresh_artist: bool = True, on_disk: DataFrame | None = None, artists: DataFrame | None = None) -> DataFrame:
    """The new version of ``content``: id, path, file_name and, where it has them, file_name_s, title,
    artist and artist_id, which ``artists`` (id, name; see ``with_artists``) gives for names.

    A plan for an entry that isn't there is an error; with ``on_disk`` (``path``), so is one with a file
    that isn't there. Of artists with one name, the least id counts.
    """
    changes = plan.select(F.col("content_id").alias("__id"), "new_path", "new_name", F.nullif("title", F.lit("")).alias("__title"), F.nullif("artist", F.lit("")).alias("__artist"))
    if on_disk is not None:
        there = on_disk.select(F.col("path").alias("new_path"), F.lit(True).alias("__there")).distinct()
        checked = F.when(F.col("__there"), F.col("new_path")).otherwise(F.raise_error(F.concat(F.lit("no such file: "), F.col("new_path"))).cast("string"))
        changes = changes.join(there, "new_path", "left").withColumn("new_path", checked).drop("__there")
    if artists is not None:
        changes = changes.join(artists.groupBy(F.col("name").alias("__artist")).agg(F.min("id").alias("__artist_id")), "__artist", "left")
    rows = content.withColumn("__here", F.lit(True)).join(changes, F.col("id").cast("string") == F.col("__id"), "full")
    vanished = F.raise_error(F.concat(F.lit("no such entry: "), F.col("__id")))
    new = {"id": F.when(F.col("__here"), F.col("id")).otherwise(vanished.cast(content.schema["id"].dataType)), "path": F.coalesce("new_path", "path"), "file_name": F.coalesce("new_name", "file_name")}
    if "file_name_s" in content.columns:
        new["file_name_s"] = F.coalesce("new_name", "file_name_s")
    if set_title and "title" in content.columns:
        new["title"] = F.coalesce("__title", "title")
    if refresh_artist and "artist" in content.columns:
        new["artist"] = F.coalesce("__artist", "artist")
    if refresh_artist and artists is not None and "artist_id" in content.columns:
        new["artist_id"] = F.coalesce("__artist_id", "artist_id")
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in content.columns])


def missing(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose path is no file's."""
    return entries.join(files.select("path"), "path", "left_anti")


def missing_sample(entries: DataFrame, files: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """One row: how many are missing, and the first of them, joined by line ends."""
    gone = missing(entries, files)
    count = gone.agg(F.count(F.lit(1)).alias("missing"), F.lit(None).cast("string").alias("sample"))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "path"))), lambda x: x["path"]), "\n")
    sample = gone.orderBy(order).limit(limit).agg(F.lit(None).cast("long").alias("missing"), first.alias("sample"))
    return count.unionByName(sample).agg(F.max("missing").alias("missing"), F.max("sample").alias("sample"))
