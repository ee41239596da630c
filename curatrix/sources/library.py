"""A health scan of a folder of files and a collection's database, from an application's settings.

Nothing is changed. Counts are aggregates of the plans behind the other operators; the driver gets one
row.
"""

from __future__ import annotations

import os
import sqlite3
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators import collection, dedup, health, naming
from curatrix.sources import database, files
from curatrix.sources.settings import Settings

SAMPLE = 5


@dataclass(frozen=True)
class Scan:
    """``report``: a row of counts with score and label; ``issues``: what to look at, in order."""

    report: DataFrame
    issues: DataFrame
    audio_files: int
    database: str
    missing_sample: tuple[str, ...]


def _collection_counts(spark: SparkSession, path: str, folder: str) -> tuple[dict, tuple[str, ...]]:
    """Counts of the entries whose path has the folder's name in it."""
    tables = database.read_collection(spark, path)
    entries = collection.load_entries(tables["content"], tables["cues"], tables["playlists"], os.path.basename(folder.rstrip("/")))
    there = files.existing(entries.select("path").distinct())
    missing, sample = collection.missing_sample(entries, there, "id", SAMPLE).first()
    found = collection.summary(collection.members(entries)).first()
    return {"missing_files": missing, "collection_groups": found["groups"], "collection_extras": found["extras"]}, tuple((sample or "").split("\n") if missing else ())


def health_scan(spark: SparkSession, folder: str, settings: Settings = Settings(), running: bool = False, candidates: tuple[str, ...] = (), options: tuple[str, ...] = ()) -> Scan:  # noqa: B008
    """Names to mend, duplicates and, unless its application is ``running``, the collection's state.

    Files are those directly in ``folder``. The database is the configured one if it is a file, else one
    that ``database.locate`` finds; one that can't be read leaves its counts at 0 and says why.
    """
    tags = files.tag_table(spark, folder) if settings.prefer_tags else None
    plan = naming.plan_counts(naming.plan_names(files.list_files(spark, folder, extensions=t.NAME_EXTENSIONS), tags, settings.naming())).first()
    scanned = dedup.with_hashes(files.scan(spark, folder, read_tags=settings.prefer_tags))
    found = dedup.summary(dedup.members(scanned)).first()
    counts = {"rename_issues": plan["to_rename"], "manual_review": plan["manual"], "file_groups": found["groups"], "file_extras": found["extras"], "missing_files": 0, "collection_groups": 0, "collection_extras": 0}
    path, error, sample = database.locate(settings.master_db, candidates, options), None, ()
    if path and not running:
        try:
            more, sample = _collection_counts(spark, path, folder)
            counts |= more
        except sqlite3.DatabaseError as e:
            error = str(e)
    row = tuple(int(counts[c] or 0) for c in health.COUNTS) + (settings.master_db is not None, path is not None, running, error)
    schema = ", ".join(f"{c} long" for c in health.COUNTS) + ", configured boolean, exists boolean, running boolean, error string"
    one = spark.createDataFrame([row], schema)
    return Scan(health.report(one), health.issues(one), plan["total"], path or settings.master_db or "", sample)
