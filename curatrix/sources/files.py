"""Folders of files as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators.codec import tags_of
from curatrix.operators.ranking import number_rows


def as_uri(path: str) -> str:
    """A path as Spark's readers give it, escaped where it has a scheme."""
    scheme, colon, rest = path.partition(":/")
    if not colon or "/" in scheme:
        return path
    return f"{scheme}:{'//' if not rest.startswith('/') else ''}/{quote(rest)}"


def all_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path`` of every file, empty ones too, which Spark's reader of contents leaves out.

    The paths come from the index of files that the reader keeps on the driver in any case.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    paths = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in found.inputFiles()]  # as the reader has it
    parts = max(1, len(paths) // 100_000)
    return spark.createDataFrame(paths, "path string").repartition(parts)


def list_files(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = t.FILE_EXTENSIONS, content: bool = False) -> DataFrame:
    """``path, name, size`` (and ``content``) of the files with these extensions, any case.

    Contents are read only where they are asked for.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    here = t.has_extension(F.col("path"), extensions)
    sized = found.select("path", F.col("length").alias("size"), *(["content"] if content else [])).where(here)
    empty = all_files(spark, folder, recursive).where(here).join(found.select("path"), "path", "left_anti")
    empty = empty.select("path", F.lit(0).cast("long").alias("size"), *([F.lit(b"").alias("content")] if content else []))
    rows = sized.unionByName(empty)
    return rows.select("path", t.split_path(F.col("path"))[1].alias("name"), *rows.columns[1:])


def walk_order(path: str = "path"):  # noqa: ANN201
    """Sorts as a walk does: a folder's files by name, then what is in its folders, each by name."""
    parts = F.split(F.col(path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    steps = F.transform(folders, lambda d: F.struct(F.lit(1).alias("kind"), d.alias("name")))
    return F.concat(steps, F.array(F.struct(F.lit(0).alias("kind"), F.element_at(parts, -1).alias("name"))))


def scan(spark: SparkSession, folder: str, recursive: bool = False, read_tags: bool = True) -> DataFrame:
    """ord, path, name, artist, title, ext, dur, size, key, content: tags, or what the name says, per field."""
    files = list_files(spark, folder, recursive, content=True)
    name_artist, name_title = t.parse_name(F.col("name"))
    if read_tags:
        files = files.withColumn("tags", tags_of("content"))
        artist = t.first_nonempty(F.coalesce(F.col("tags.artist"), F.lit("")), name_artist)
        title = t.first_nonempty(F.coalesce(F.col("tags.title"), F.lit("")), name_title)
    else:
        artist, title = name_artist, name_title
    order = number_rows(list_files(spark, folder, recursive).select("path", walk_order().alias("w")), ["w"], "ord").select("path", "ord")
    rows = files.withColumn("artist", artist).withColumn("title", title).join(order, "path")
    return rows.select("ord", "path", "name", "artist", "title", t.ext_of(F.col("path")).alias("ext"), F.lit(None).cast("double").alias("dur"), "size", t.norm_key(F.col("artist"), F.col("title")).alias("key"), "content")


def tag_table(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``name, artist, title`` of the files with readable tags."""
    tags = list_files(spark, folder, recursive, content=True).select("name", tags_of("content").alias("tags"))
    return tags.where(F.col("tags.artist").isNotNull() | F.col("tags.title").isNotNull()).select("name", F.coalesce(F.col("tags.artist"), F.lit("")).alias("artist"), F.coalesce(F.col("tags.title"), F.lit("")).alias("title"))


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every regular file below a folder."""
    return all_files(spark, folder, recursive=True)


def existing(paths: DataFrame) -> DataFrame:
    """The rows (``path``) whose path is a file; tasks look, each at its own rows' paths."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            there = []
            for path in batch["path"]:
                try:
                    fs, where = pafs.FileSystem.from_uri(as_uri(path)) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
                    there.append(fs.get_file_info(where).type == pafs.FileType.File)
                except (OSError, ValueError):
                    there.append(False)
            yield batch[there]

    return paths.select("path").where("path IS NOT NULL").mapInPandas(look, "path string")
