"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.lineage import materialize, shared_path

__all__ = ["kth_largest", "materialize", "shared_path", "small_batches", "some_by_hash", "spare", "table", "text_or_empty"]

_BINS = 4096

#: Bytes of an Arrow batch between Spark and Python. Both hold a few at a time, beside the heap.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays.

    Spark's own bound, 64 MB, is held several times over by each task and its Python worker.
    """
    now = spark.conf.get(_SETTING, "64m").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    size = int(now.rstrip("kmg")) * unit
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(_SETTING, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """``name`` with as many signs behind it that no column of ``df`` has it, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(df[column].cast("string"), F.lit(""))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``key``, or None where there are fewer rows.

    Keys are counted in ranges of equal width, then in the one that holds it, and so on: the driver
    gets 4096 numbers at a time at most, and no task sorts.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or n < k:
        return None if k > 0 else (high or 0) + 1
    while low < high:
        width = -(-(high - low + 1) // _BINS)
        inside = keys.where(F.col("key").between(low, high)).groupBy(F.expr(f"(key - ({low}L)) div {width}L").alias("bin")).count()
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if k <= r["count"]:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            k -= r["count"]
    return low


def some_by_hash(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows whose column has the ``most`` largest hashes; all, if they are fewer.

    ``df`` is computed once. A sort with a limit would send as many rows from every partition.
    """
    held = materialize(df, "chosen")
    key = F.shiftright(F.xxhash64(column), 2)
    at = kth_largest(held.select(key.alias("key")), most)
    return held if at is None else held.where(key >= at)
