"""Where intermediate tables go, and how a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none (a test) gets a temporary folder of this machine; on a cluster
    that is an error, for executors couldn't read it.
    """
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = context.getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = tempfile.mkdtemp(prefix="curatrix-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    A lost executor then costs a read, not the work above; later readers keep column pruning and
    filters, and what is used twice is computed once.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> int:
    """Delete what this process has put into the shared folder; how many paths that were.

    For when results have been written: DataFrames that read such tables can't be used afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    n = len(_made)
    _made.clear()
    return n
