"""Plans for canonical file names: ``Artist - Title (Mix).ext``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.lineage import materialize
from curatrix.operators.ranking import number_within

#: Rows of one target that a window may hold.
HOT_NAMES = 1_000_000


@dataclass(frozen=True)
class Options:
    """``source`` is "tags" or "filename": which of both comes first."""

    source: str = "tags"
    alphabetical: bool = True
    keep_mix: bool = True

    @classmethod
    def from_settings(cls, settings: dict) -> Options:
        """Of an application's settings; the mix is always kept there."""
        return cls("tags" if settings.get("prefer_tags", True) else "filename", settings.get("alphabetical", True), True)


def build_names(rows: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """``rows`` (name; artist, title: tags or null) as ``old, new, origin``.

    An empty name means that a person must choose. Each step is a projection of its own, so that what
    later ones use twice is computed once.
    """
    c = F.col
    out = rows.select(c("name"), t.clean_tag(F.coalesce("artist", F.lit(""))).alias("tag_artist"), t.clean_tag(F.coalesce("title", F.lit(""))).alias("tag_title"), t.base_of_name(c("name")).alias("base"))
    out = out.withColumn("parts", t.segments(c("base")))
    artist, title = t.parse_base(c("base"), c("parts"))
    out = out.withColumn("name_artist", artist).withColumn("name_title", title)
    if options.source == "filename":
        a, b, origin = t.first_nonempty(c("name_artist"), c("tag_artist")), t.first_nonempty(c("name_title"), c("tag_title")), F.lit("filename")
    else:
        both = (c("tag_artist") != "") & (c("tag_title") != "")
        full = t.add_missing_mix(c("tag_title"), c("name_title")) if options.keep_mix else c("tag_title")
        a = t.first_nonempty(c("tag_artist"), c("name_artist"))
        b = F.when(both, full).otherwise(t.first_nonempty(c("tag_title"), c("name_title")))
        origin = F.when(both, "tags").when((c("tag_artist") != "") | (c("tag_title") != ""), "mixed").otherwise("filename")
    out = out.select("name", t.std_feat(a).alias("a"), t.std_feat(b).alias("b"), origin.alias("origin"))
    out = out.withColumn("a", F.when(c("a") == "", "").otherwise(t.sort_artists(c("a"), options.alphabetical)))
    known = (c("a") != "") & (c("b") != "")
    new = F.concat(t.sanitize(t.dedupe_parens(F.concat_ws(" - ", "a", "b"))), F.lower(t.splitext(c("name"))[1]))
    return out.select(c("name").alias("old"), F.when(known, new).otherwise("").alias("new"), F.when(known, c("origin")).otherwise("manual").alias("origin"))


def add_suffixes(plan: DataFrame) -> DataFrame:
    """Of rows with one target, case aside, the n-th by ``old`` gets `` (n)``, n from 2.

    A suffixed name isn't checked again. A target of more than HOT_NAMES rows is numbered in ranges of
    ``old`` by many tasks; the others' windows are small.
    """
    rows = materialize(plan.withColumn("__key", F.lower("new")).withColumn("__at", F.monotonically_increasing_id()), "plan")
    # Names left to a person form no group.
    named = number_within(rows.where("new <> ''"), "__key", ["old", "__at"], "__n", HOT_NAMES)
    numbered = named.unionByName(rows.where("new = ''").withColumn("__n", F.lit(1).cast("long")))
    root, ext = t.splitext(F.col("new"))
    again = (F.col("new") != "") & (F.col("__n") > 1)
    return numbered.withColumn("new", F.when(again, F.concat(root, F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), ext)).otherwise(F.col("new"))).select(*plan.columns)


def plan_names(files: DataFrame, tags: DataFrame | None = None, options: Options = Options()) -> DataFrame:  # noqa: B008
    """``old, new, origin`` for files (``name``) and, if there, tags (``name, artist, title``)."""
    rows = files.select("name").where(t.has_extension(F.col("name"), t.NAME_EXTENSIONS))
    if tags is None:
        rows = rows.withColumn("artist", F.lit("")).withColumn("title", F.lit(""))
    else:
        rows = rows.join(tags.select("name", "artist", "title"), "name", "left")
    return add_suffixes(build_names(rows, options))


def changed(plan: DataFrame) -> DataFrame:
    return plan.where("new <> '' AND new <> old")


def manual(plan: DataFrame) -> DataFrame:
    return plan.where("new = ''")


def unchanged(plan: DataFrame) -> DataFrame:
    return plan.where("new = old")


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: total, to_rename, already_correct, manual."""
    return plan.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("new") != "") & (F.col("new") != F.col("old"))).alias("to_rename"),
        F.count_if(F.col("new") == F.col("old")).alias("already_correct"),
        F.count_if(F.col("new") == "").alias("manual"),
    )


def rename_map(plan: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """``old, new`` of the renames, of those only that were done (``old``) if these are given."""
    pairs = changed(plan).select("old", "new")
    return pairs if done is None else pairs.join(done.select("old"), "old", "left_semi")


def rollback(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("new").alias("current_name"), F.col("old").alias("restore_to"))
