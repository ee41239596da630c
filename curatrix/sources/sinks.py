"""Reports as CSV: a byte order mark, CRLF, quotes only where needed and doubled inside."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators import naming

PLAN_HEADER, ROLLBACK_HEADER = ("OLD name", "NEW name", "from"), ("current_name", "restore_to")  # fixed values


def plan_rows(plan: DataFrame) -> DataFrame:
    rows = naming.changed(plan).orderBy("old")
    return rows.select(*[F.col(c).alias(h) for c, h in zip(("old", "new", "origin"), PLAN_HEADER, strict=True)])


def rollback_rows(pairs: DataFrame) -> DataFrame:
    return naming.rollback(pairs).select(*ROLLBACK_HEADER)


def write_parts(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, written by the executors; the way for large reports."""
    df.write.csv(path, header=True, escape='"', lineSep="\r\n", mode="overwrite")


def write_single(df: DataFrame, path: str) -> int:
    """One file in exactly the dialect, through Hadoop's file system; rows come one partition at a time.

    Returns the number of rows. The report is never in memory as a whole.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    n, buffer = 0, io.StringIO()
    writer = csv.writer(buffer, lineterminator="\r\n")
    try:
        buffer.write("\ufeff")
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if x is None else x for x in row])
            n += 1
            if buffer.tell() > 1 << 16:
                out.write(bytearray(buffer.getvalue().encode()))
                buffer.seek(0)
                buffer.truncate()
        out.write(bytearray(buffer.getvalue().encode()))
    finally:
        out.close()
    return n
