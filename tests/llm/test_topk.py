import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import topk


def brute(rows, query, k, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if query(i):
            hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rank string")
    return sorted(map(tuple, topk.top_k(df, df.where("vec_id % 5 = 0"), k, "vec_id", "embedding", **options).collect()))


def test_brute_force_with_ties_and_bad_rows(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.choice([0, 0.5, -1, rng.random()]))) for _ in range(3)]) for i in range(120)]
    rows += [(200, None), (205, [1.0, None, 0.0]), (210, [float("nan"), 0.0, 0.0]), (215, [float("inf"), 0.0, 0.0]), (220, [1.0, 2.0]), (225, [0.5, -1.0]), (230, []), (None, [1.0, 1.0, 1.0])]
    rows += [(300 + i, [0.5, 0.5, 0.5]) for i in range(40)]
    want = brute(rows, lambda i: i % 5 == 0, 5)
    assert run(spark, rows) == want
    assert run(spark, rows, tile_rows=7, query_rows=4) == want


def test_many_tiles_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(100)]
    assert run(spark, rows, tile_rows=5) == brute(rows, lambda i: i % 5 == 0, 5)


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


@pytest.mark.parametrize("scale", [1, 10**7, 7 * 10**8])
def test_scores_stay_exact(scale):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-3, 4, (3, 2)) * scale, rng.integers(-3, 4, (6, 2)) * scale
    ids = np.arange(6) + 10
    of, found, score = topk.best(a, np.array([10, 11, 99]), b, ids, 3)
    for q in range(3):
        want = sorted((-int(sum(int(x) * int(y) for x, y in zip(a[q], b[j], strict=True))), int(ids[j])) for j in range(6) if ids[j] != [10, 11, 99][q])[:3]
        got = sorted((-int(s), int(i)) for o, i, s in zip(of, found, score, strict=True) if o == q)
        assert got == want


def test_column_names_do_not_clash(spark):
    df = spark.range(4).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.lit(1).alias("lane"), F.lit(2).alias("tile"))
    assert topk.top_k(df, df.where("vec_id = 0"), 2, "vec_id", "embedding").count() == 2


def test_tiles_spread_over_lanes(spark):
    for tasks, made in ((400, 1), (50, 8)):
        numbers = spark.range(tasks).select((F.shiftleft("id", 32)).alias("t")).join(spark.range(made)).select((F.col("t") + F.col("id")).alias("tile"))
        for lanes in (8, 200):
            sizes = [r["count"] for r in numbers.groupBy(topk.lane_of("tile", lanes).alias("lane")).count().collect()]
            assert len(sizes) > 0.75 * lanes and max(sizes) < 4 * 400 / lanes + 8


def test_more_lanes_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(topk, "LANE_TILES", 1)
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(100)]
    assert run(spark, rows, tile_rows=5) == brute(rows, lambda i: i % 5 == 0, 5)


@pytest.mark.parametrize("top, size", [(0, 1), (-128, 1), (128, 2), (-40000, 4), (2**31, 8), (-(2**62), 8)])
def test_matrices_are_packed_narrowly(top, size):
    m = np.array([[1, 2, 3], [top, 0, -1]], np.int64)
    raw = topk.narrow(m)
    assert len(raw) == 6 * size and (topk.wide(np.frombuffer(raw, np.uint8), 2, 3) == m).all()
    assert topk.wide(np.zeros(0, np.uint8), 0, 3).shape == (0, 3) and topk.wide(np.zeros(0, np.uint8), 2, 0).shape == (2, 0)
