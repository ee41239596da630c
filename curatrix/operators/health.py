"""A library's health: a score of five counts, a label, and a list of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def score(rename: Column, extras: Column, missing: Column, unavailable: Column, groups: Column) -> Column:
    """100 less bounded penalties: each for so many steps of a count."""
    penalty = F.least(_steps(rename, 20), F.lit(20)) + F.least(_steps(extras, 10) * 2, F.lit(25)) + F.least(_steps(missing, 10) * 2, F.lit(30)) + F.when(unavailable, 5).otherwise(0) + F.least(groups, F.lit(15))
    return F.greatest(F.lit(100) - penalty, F.lit(0)).cast("int")


def label(c: Column) -> Column:
    return F.when(c >= 90, "Healthy").when(c >= 60, "Needs attention").otherwise("Critical")


COUNTS = ("rename_issues", "manual_review", "file_groups", "file_extras", "missing_files", "collection_groups", "collection_extras")


def report(counts: DataFrame) -> DataFrame:
    """``counts`` (COUNTS; configured, exists, running: boolean; error) with score and label."""
    unavailable = F.col("configured") & ~F.col("exists")
    out = counts.withColumn("score", score(F.col("rename_issues"), F.col("file_extras"), F.col("missing_files"), unavailable, F.col("collection_groups")))
    return out.withColumn("label", label(F.col("score")))


def issues(counts: DataFrame) -> DataFrame:
    """``place, code, severity, count``: what to look at, in order; one row says so if nothing."""
    c = F.col
    one = F.lit(1).cast("long")
    found = [
        (c("rename_issues") > 0, "rename-issues", "warning", c("rename_issues")),
        (c("manual_review") > 0, "manual-review", "warning", c("manual_review")),
        (c("file_groups") > 0, "file-duplicates", "warning", c("file_extras")),
        (c("missing_files") > 0, "missing-files", "critical", c("missing_files")),
        (c("collection_groups") > 0, "collection-duplicates", "warning", c("collection_extras")),
        (~c("exists") & c("configured"), "collection-unavailable", "warning", one),
        (~c("exists") & ~c("configured"), "collection-not-configured", "warning", one),
        (c("exists") & c("running"), "collection-running", "info", one),
        (c("exists") & ~c("running") & c("error").isNotNull(), "collection-inspection", "warning", one),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.cast("long").alias("count"), when.alias("there")) for i, (when, code, severity, n) in enumerate(found, 1)])
    there = F.filter(rows, lambda r: r["there"])
    healthy = F.array(F.struct(F.lit(1).alias("place"), F.lit("healthy").alias("code"), F.lit("info").alias("severity"), F.lit(0).cast("long").alias("count"), F.lit(True).alias("there")))
    return counts.select(F.explode(F.when(F.size(there) > 0, there).otherwise(healthy)).alias("i")).select("i.place", "i.code", "i.severity", "i.count")
