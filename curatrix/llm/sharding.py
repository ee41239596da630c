"""Sharding: a uniform shuffle of all rows into shards whose sizes are exact.

A uniform shuffle deals, from each part of the input to each part of the output, a number of rows
that follows the multivariate hypergeometric law. So the matrix of counts is fixed first, by part sizes and
a seed alone; each input part then permutes its rows locally and cuts them by its row of the matrix;
rows are exchanged; and each output part permutes what it got. The result is a uniform permutation,
and shard sizes are exact: they differ by one row at most.

The matrix is never held: it is a tree over the parts, in which each node deals its cells' rows to both
halves of its parts by a draw of its own seed. A part's row is what is left on the way down to it, one
draw of all cells for each of log2(parts) levels, and any task draws it alike.

A shard may hold far more than a task can, so it is made of cells, the true output parts. Slots run
through the cells of a shard one after the other.

Equal texts are dealt like any other rows: only a law that keeps groups together would bind them.

Defined cases: null, empty, repeated and tied rows are rows like others; an empty table gives no
rows; columns of the input keep their names, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import materialize, spare

#: Rows of a cell and bytes of its texts, at most or so: a task permutes one cell at a time.
CELL_ROWS, CELL_BYTES = 1_000_000, 128 << 20
#: Rows of an input part are 2**PART_BITS at most, whatever the size of a Spark partition.
PART_BITS = 20
_LARGE = 10**9  # numpy draws from fewer


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good. numpy's sampler stops at _LARGE."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _LARGE:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mean = n * good / total
    spread = math.sqrt(max(1.0, mean * (1 - good / total) * (total - n) / max(1, total - 1)))
    k = np.arange(max(low, int(mean - 12 * spread)), min(high, int(mean + 12 * spread) + 1) + 1, dtype=np.float64)
    # log of p(k+1)/p(k), summed from the left: only ratios matter
    step = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1])])


def deal(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Exact counts of ``n`` draws without replacement from bins holding ``left``.

    Where numpy can't draw from so many, halves of the bins share the draws first.
    """
    total = int(left.sum())
    if total < _LARGE:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    if len(left) == 1:
        return np.array([n], np.int64)
    half = len(left) // 2
    first = int(left[:half].sum())
    k = hypergeometric(rng, first, total - first, n)
    return np.concatenate([deal(rng, left[:half], k), deal(rng, left[half:], n - k)])


class Matrix:
    """Rows of the matrix of counts: row sums are ``parts``, column sums are ``cells``.

    The way down to the last row is kept, so rows asked for in order cost few draws each.
    """

    def __init__(self, parts: np.ndarray, cells: np.ndarray, seed: int):
        self.before = np.concatenate([[0], np.cumsum(parts.astype(np.int64))])
        self.seed = seed
        self.way = [(0, len(parts), cells.astype(np.int64))]

    def row(self, i: int) -> np.ndarray:
        while not self.way[-1][0] <= i < self.way[-1][1]:
            self.way.pop()
        low, high, cells = self.way[-1]
        while high - low > 1:
            middle = (low + high) // 2
            left = deal(np.random.default_rng([self.seed, 0, low, high]), cells, int(self.before[middle] - self.before[low]))
            low, high, cells = (low, middle, left) if i < middle else (middle, high, cells - left)
            self.way.append((low, high, cells))
        return cells


def cells_per_shard(rows: int, size: int, shards: int, cell_rows: int, tasks: int) -> int:
    """As many as rows, bytes and the number of tasks ask for."""
    return max(1, *(math.ceil(n / shards) for n in (rows / cell_rows, size / CELL_BYTES, tasks)))


def cell_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes of the cells, shard by shard; shards differ by one row at most, cells of one too."""
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    return np.array([[n // per_shard + (c < n % per_shard) for c in range(per_shard)] for n in sizes], np.int64).reshape(-1)


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 17, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    A row's part and place in it are written with the row, so that what it draws depends on neither
    the task that reads it nor a retry. The driver gets a number per part of 2**PART_BITS rows and
    sends it to all tasks, 16 bytes for a million rows or so. A column of ``df`` named like one of the
    new ones is replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    at_name, cell_name, key_name = (spare(df, n) for n in ("__at", "__cell", "__key"))
    held = materialize(df.withColumn(at_name, F.monotonically_increasing_id()), "shard")
    part = F.shiftright(F.col(at_name), PART_BITS)
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    each = sum(wide, F.lit(8 * (1 + len(df.columns)))).cast("long")
    found = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("bytes")).toPandas().sort_values("part")
    parts, counts = found["part"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    rows = int(counts.sum())
    per_shard = cells_per_shard(rows, int(found["bytes"].sum()), shards, cell_rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = spark.sparkContext.broadcast((parts, counts))
    sizes = (rows, shards, per_shard)
    schema = T.StructType([*held.schema.fields, T.StructField(cell_name, T.IntegerType()), T.StructField(key_name, T.LongType())])

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = known.value
        matrix = Matrix(counts, cell_sizes(*sizes), seed)
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(p: int) -> tuple[np.ndarray, np.ndarray]:
            """The cell and the sorting key of each place of part ``p``."""
            if p not in drawn:
                i = int(np.searchsorted(numbers, p))
                own = matrix.row(i)
                rng = np.random.default_rng([seed, 1, i])
                drawn.clear()
                drawn[p] = rng.permutation(np.repeat(np.arange(len(own), dtype=np.int32), own)), rng.integers(-(1 << 63), (1 << 63) - 1, int(own.sum()))
            return drawn[p]

        for batch in batches:
            at = batch.column(batch.schema.get_field_index(at_name)).to_numpy()
            part, pos = at >> PART_BITS, at & ((1 << PART_BITS) - 1)
            cell, key = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for p in np.unique(part).tolist():
                mine = part == p
                cells, keys = of(p)
                cell[mine], key[mine] = cells[pos[mine]], keys[pos[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(key)], names=[*batch.schema.names, cell_name, key_name])

    c, s = F.col(cell_name) % per_shard, F.floor(F.col(cell_name) / per_shard)
    n = F.lit(rows // shards).cast("long") + F.when(s < rows % shards, 1).otherwise(0)
    first = c * F.floor(n / per_shard) + F.least(c, n % per_shard)
    place = F.row_number().over(Window.partitionBy(cell_name).orderBy(key_name, at_name)) - 1
    sent = held.mapInArrow(permute, schema).withColumn("slot", (first + place).cast("long")).withColumn("shard", s.cast("int"))
    return sent.drop(at_name, cell_name, key_name)
