"""Mappings of old names to new ones from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as t

# fixed values: the two layouts; the second is read backwards
LAYOUTS = (("old name", "new name"), ("restore_to", "current_name"))


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``old, new, ord``: header names are matched trimmed and in lower case, values are trimmed.

    A rollback table maps the other way. Other headers are an error; rows that miss a value are left
    out. ``ord`` follows the file, so that of rows with one old name the last can count.
    """
    rows = spark.read.csv(path, header=True, escape='"', mode="PERMISSIVE")
    names = {c.strip().lower().lstrip("\ufeff"): c for c in rows.columns}
    for old, new in LAYOUTS:
        if old in names and new in names:
            pick = lambda c: t.utrim(F.col(f"`{names[c]}`"))  # noqa: B023, E731
            pairs = rows.select(pick(old).alias("old"), pick(new).alias("new"), F.monotonically_increasing_id().alias("ord"))
            return pairs.where(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != "") & (F.col("new") != ""))
    raise ValueError(f"unknown mapping header: {rows.columns}")
