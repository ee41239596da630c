"""Collection tables of an SQLite file, as DataFrames.

The file is on the driver's machine and is opened read-only; an encrypted one must be decrypted by its
own tools before. Rows are written to the shared folder in pieces, so none is held whole.
"""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.lineage import shared_path

PIECE = 50_000
# fixed values: tables and columns, and what they are called here
TABLES = {
    "content": ("djmdContent", {"ID": "id", "FolderPath": "path", "FileNameL": "file_name", "FileNameS": "file_name_s", "Title": "title", "ArtistID": "artist_id", "created_at": "created", "DJPlayCount": "plays", "Rating": "rating", "Commnt": "comment"}),
    "cues": ("djmdCue", {"ID": "id", "ContentID": "content_id"}),
    "playlists": ("djmdSongPlaylist", {"ID": "id", "PlaylistID": "playlist_id", "ContentID": "content_id"}),
    "artists": ("djmdArtist", {"ID": "id", "Name": "name"}),
}


def from_options(path: str) -> str | None:
    """The database that an application's options file (JSON) names as its ``db-path``, if any."""
    try:
        with open(path, encoding="utf-8") as f:
            pairs = json.load(f)["options"]
        return next((str(p[1]) for p in pairs if p[0] == "db-path"), None)
    except (OSError, ValueError, LookupError, TypeError):
        return None


def locate(configured: str | None, candidates: tuple[str, ...] = (), options: tuple[str, ...] = ()) -> str | None:
    """The first of these that is a file: the configured one, candidates, and what options files name."""
    named = (from_options(o) for o in options)
    return next((p for p in (configured, *candidates, *named) if p and Path(p).is_file()), None)


def read_collection(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables by name; all columns are strings but ``plays`` and ``rating``."""
    out = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for name, (table, columns) in TABLES.items():
            target = shared_path(spark, name)
            schema = ", ".join(f"{c} string" for c in columns.values())
            rows = db.execute(f"SELECT {', '.join(f'CAST({c} AS TEXT)' for c in columns)} FROM {table}")
            piece = rows.fetchmany(PIECE)
            while True:
                spark.createDataFrame(piece, schema).write.mode("append").parquet(target)
                if not (piece := rows.fetchmany(PIECE)):
                    break
            df = spark.read.schema(schema).parquet(target)
            for c in ("plays", "rating"):
                if c in df.columns:
                    df = df.withColumn(c, F.col(c).cast("int"))
            out[name] = df
    return out
