"""Numbers in a total order without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.lineage import materialize


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, 1, 2, ... by ``order``, which must be a total order.

    Rows are cut into ranges by order; each range is numbered for itself, and a count per range (as
    many numbers as there are shuffle partitions) gives what to add. ``df`` is computed twice, once for
    the ranges' bounds, so it should be cheap to read, as from a table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    each = cut.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # One row a range: never more than the shuffle partitions.
    return each.join(F.broadcast(counts.select("__range", "__before")), "__range").withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__range", "__place", "__before")


def number_within(df: DataFrame, key: str, order: list[str], name: str, hot: int = 1_000_000) -> DataFrame:
    """``df`` with ``name``, 1, 2, ... by ``order`` among the rows of each ``key``; read several times.

    Keys of up to ``hot`` rows are windows; rows of others are numbered in ranges by many tasks.
    """
    large = df.groupBy(key).count().where(F.col("count") > hot).select(key)
    window = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    if not large.take(1):
        return df.withColumn(name, window)
    large = materialize(large, "hot")
    few = df.join(large, key, "left_anti").withColumn(name, window)
    many = materialize(number_rows(df.join(large, key, "left_semi"), [key, *order], "__number"), "hot")
    first = materialize(many.groupBy(key).agg(F.min("__number").alias("__first")), "hot")
    many = many.join(first, key).withColumn(name, F.col("__number") - F.col("__first") + 1)
    return few.unionByName(many.select(*few.columns))
