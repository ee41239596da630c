"""Exact top-k search by inner product: tiles of queries times tiles of candidates.

Vectors become whole numbers, floor(scale * x), so scores are exact. Candidates are packed into
tiles of bounded size and queries into blocks; each block meets each tile once, through an equality
join on lanes, as a matrix product. Tiles are dealt to lanes by a hash of their number, LANE_TILES to
each or so, and both sides of the join are sorted, so they can spill. Matrices hold whole numbers of the
fewest bytes that all of a tile's fit in. From every product only k entries a query leave, chosen by score
and then id, and the lists of a query are merged in a tree whose nodes take a bounded number of lists.

Defined cases: vectors that are null, or hold null or non-finite components, take no part. Vectors of
other lengths never meet. Rows with the query's own id are the query's own and are no candidates for
it; other rows of equal ids are candidates each, and each row of the query set has lists of its own.
Rows with a null id take no part. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

TILE_ROWS, QUERY_ROWS, FAN_IN, LANE_TILES = 4096, 1024, 64, 16
_TILE = "dim int, tile long, ids binary, matrix binary"


def whole_numbers(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """``id``, ``dim``, ``v``: the vectors that take part, as arrays of longs."""
    x = F.col(vector)
    good = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) != float("inf")))
    v = F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double")).cast("long"))
    return df.where(F.col(id_column).isNotNull() & x.isNotNull() & good).select(F.col(id_column).cast("long").alias("id"), F.size(x).alias("dim"), v.alias("v"))


def narrow(m: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they all fit in; how many is told by the length."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return m.astype(kind).tobytes()


def wide(raw: np.ndarray, rows: int, dim: int) -> np.ndarray:
    """The matrix that ``narrow`` packed."""
    return raw.view(f"i{raw.size // (rows * dim)}").reshape(rows, dim).astype(np.int64) if rows * dim else np.zeros((rows, dim), np.int64)


def pack(df: DataFrame, rows: int) -> DataFrame:
    """Rows packed into matrices of ``rows`` rows at most, sorted by id, all of one length."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        made = 0

        def give(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids = np.concatenate([a for a, _ in held[dim]])
            m = np.concatenate([b for _, b in held.pop(dim)])
            order = np.argsort(ids, kind="stable")
            number = (task << 32) + made
            made += 1
            return pa.RecordBatch.from_pydict({"dim": [dim], "tile": [number], "ids": [ids[order].tobytes()], "matrix": [narrow(m[order])]}, schema=pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary())]))

        for batch in batches:
            ids, dims = (batch.column(k).to_numpy() for k in (0, 1))
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                m = batch.column(2).take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), dim) if dim else np.zeros((len(mine), 0), np.int64)
                for low in range(0, len(mine), rows):
                    cut = slice(low, low + rows)
                    if sum(len(a) for a, _ in held.get(dim, [])) + len(mine[cut]) > rows:
                        yield give(dim)
                    held.setdefault(dim, []).append((ids[mine[cut]].copy(), m[cut].copy()))
        for dim in list(held):
            yield give(dim)

    return df.select("id", "dim", "v").mapInArrow(tiles, _TILE)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows, as (query, id, score); ``ids`` ascend, so ties go to smaller ids."""
    top = lambda m: int(np.abs(m).max(initial=0))
    bound, n = top(queries) * top(rows) * max(1, queries.shape[1]), len(ids)
    if bound * (2 * n) < 1 << 53:
        scores = (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    elif bound < 1 << 62:
        scores = queries @ rows.T
    else:
        scores = queries.astype(object) @ rows.astype(object).T  # a score beyond a long fails below
    own = query_ids[:, None] == ids[None, :]
    if bound * (2 * n) < 1 << 62:
        # One number orders both: the score first, then the place from the end.
        key = scores * n + np.arange(n - 1, -1, -1)
        key[own] = -(1 << 63)
        keep = min(k, n)
        at = np.argpartition(key, n - keep, axis=1)[:, n - keep :]
    else:
        order = [sorted((j for j in range(n) if not own[i, j]), key=lambda j: -scores[i, j])[:k] for i in range(len(queries))]  # noqa: B023  stable
        at = np.array([o + [-1] * (k - len(o)) for o in order]).reshape(len(queries), -1)
    q = np.repeat(np.arange(len(queries)), at.shape[1])
    at = at.reshape(-1)
    there = (at >= 0) & ~own[q, at]
    return q[there], ids[at[there]], scores[q[there], at[there]].astype(np.int64)


def lane_of(tile: str, lanes: int) -> Column:
    """A tile's lane: a hash, as numbers of tiles are far from each other."""
    return F.pmod(F.xxhash64(tile), F.lit(lanes)).cast("int")


def merge(lists: DataFrame, keys: list[str], by: Column, k: int) -> DataFrame:
    """The k best of the lists that share ``keys`` and ``by``, as one list."""
    both = lists.groupBy(*keys, by.alias("node")).agg(F.flatten(F.collect_list("found")).alias("found"))
    return both.withColumn("found", F.slice(F.array_sort("found"), 1, k))


def top_k(df: DataFrame, queries: DataFrame, k: int, id_column: str, vector: str, scale: int = 256, tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` (long): each query's k best rows of ``df``.

    Both sides may be of any size: blocks of queries are sent once to each lane, not broadcast.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tiles = materialize(pack(whole_numbers(df, id_column, vector, scale), tile_rows), "tiles")
    count = tiles.count()
    lanes = max(1, min(parts, count), count // LANE_TILES)
    tiles = tiles.withColumn("lane", lane_of("tile", lanes))
    asked = pack(whole_numbers(queries, id_column, vector, scale).repartition(max(1, parts // 8)), query_rows)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("tile").alias("block"), F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    met = tiles.hint("merge").join(asked, ["dim", "lane"]).select("dim", "tile", "ids", "matrix", "block", "query_ids", "queries")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, tile, block = (batch.column(c)[i].as_py() for c in (0, 1, 4))
                ids, query_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (2, 5))
                m, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (3, 6))
                of, found, score = best(wide(q, len(query_ids), dim), query_ids, wide(m, len(ids), dim), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), block)), pa.array(of.astype(np.int32)), pa.array(query_ids[of]), pa.array(np.full(len(of), tile)), pa.array(-score), pa.array(found)], names=["block", "place", "query_id", "tile", "worse", "vec_id"])

    rows = met.mapInArrow(products, "block long, place int, query_id long, tile long, worse long, vec_id long")
    keys = ["block", "place", "query_id"]
    lists = rows.groupBy(*keys, F.col("tile").alias("node")).agg(F.array_sort(F.collect_list(F.struct("worse", "vec_id"))).alias("found"))
    # Tiles are numbered task by task, so nodes are found by hashing: about FAN_IN lists meet in each.
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        lists = merge(lists, keys, F.pmod(F.xxhash64("node"), F.lit(count)), k)
    merged = merge(lists, keys, F.lit(0), k)
    ranked = merged.select("query_id", F.posexplode("found").alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.worse")).alias("score"))
