import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import queries, sharding


@pytest.mark.parametrize("rows, shards", [(1000, 16), (5, 16), (0, 4), (100, 1)])
def test_sizes_are_exact_and_slots_gapless(spark, rows, shards):
    out = sharding.shuffle_into_shards(spark.range(rows, numPartitions=3), shards, cell_rows=20).collect()
    assert sorted(r.id for r in out) == list(range(rows))
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))


def test_rows_bytes_and_tasks_make_cells(spark, monkeypatch):
    assert sharding.cells_per_shard(0, 0, 16, 10**6, 8) == 1
    assert sharding.cells_per_shard(10**8, 0, 16, 10**6, 8) == 7
    assert sharding.cells_per_shard(10, 64 << 30, 16, 10**6, 8) == 32
    assert sharding.cells_per_shard(10, 10, 16, 10**6, 200) == 13
    monkeypatch.setattr(sharding, "CELL_BYTES", 3000)
    df = spark.range(40, numPartitions=2).select("id", F.repeat(F.lit("é"), 500).alias("text"), F.lit(None).cast("binary").alias("b"))
    rows = sharding.shuffle_into_shards(df, 2).collect()
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(20)) for s in range(2))


def test_same_seed_same_result(spark):
    df = spark.range(300, numPartitions=4)
    first, again, other = (sorted(map(tuple, sharding.shuffle_into_shards(df, 4, seed).collect())) for seed in (1, 1, 2))
    assert first == again != other


def test_nulls_repeats_and_other_columns(odd_docs):
    out = sharding.shuffle_into_shards(odd_docs, 3)
    assert sorted(map(repr, out.select(*odd_docs.columns).collect())) == sorted(map(repr, odd_docs.collect()))


def matrix(parts, cells, seed):
    m = sharding.Matrix(parts, cells, seed)
    return np.array([m.row(i) for i in range(len(parts))])


def test_rows_of_the_matrix_do_not_depend_on_the_order(monkeypatch):
    rng = np.random.default_rng(0)
    parts, cells = rng.integers(0, 50, 37), np.zeros(5, np.int64)
    np.add.at(cells, rng.integers(0, 5, parts.sum()), 1)
    whole = matrix(parts, cells, 3)
    assert (whole.sum(1) == parts).all() and (whole.sum(0) == cells).all()
    m = sharding.Matrix(parts, cells, 3)
    for i in rng.permutation(37).tolist() + [5, 5, 6]:
        assert (m.row(i) == whole[i]).all()
    # What numpy can't draw at once is shared by halves of the cells.
    monkeypatch.setattr(sharding, "_LARGE", 100)
    other = matrix(parts, cells, 3)
    assert (other.sum(1) == parts).all() and (other.sum(0) == cells).all()


def test_a_matrix_of_many_parts_is_drawn_row_by_row():
    parts, cells = np.full(100_000, 1 << 20), np.full(1600, 100_000 * (1 << 20) // 1600)
    m = sharding.Matrix(parts, cells, 1)
    rows = [m.row(i) for i in (0, 1, 2, 99_999)]
    assert all(r.sum() == 1 << 20 for r in rows) and len(m.way) < 20
    assert abs(np.mean(rows) - 655.36) < 1e-9 and 20 < np.std(rows[0]) < 32


def test_matrix_sums_and_means():
    parts, cells = np.array([30, 0, 70, 100]), np.array([50, 100, 50])
    draws = np.array([matrix(parts, cells, s) for s in range(2000)])
    assert (draws.sum(2) == parts).all() and (draws.sum(1) == cells).all()
    want = np.outer(parts, cells) / 200
    assert np.abs(draws.mean(0) - want).max() < 0.3
    # The variance of a hypergeometric count: 30 draws from 50 of 200.
    assert abs(draws[:, 0, 0].var() - 30 * 0.25 * 0.75 * 170 / 199) < 0.5


def test_every_place_is_equally_likely(spark):
    n, hits = 40, Counter()
    for seed in range(30):
        for r in sharding.shuffle_into_shards(spark.range(n, numPartitions=2), 4, seed).where("id < 10").collect():
            hits[r.shard, r.slot] += 1
    chi = sum((hits[s, k] - 7.5) ** 2 / 7.5 for s in range(4) for k in range(10))
    assert chi < 75  # 39 degrees of freedom: 99.95 %


def test_large_counts():
    rng = np.random.default_rng(1)
    draws = np.array([sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(300)])
    assert abs(draws.mean() - 750_000) < 150 and 300 < draws.std() < 600


def test_query_columns_by_plain_reckoning(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "rows", None) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_names_that_clash(spark):
    df = spark.range(30).select("id", F.lit("x").alias("shard"), F.lit(2).alias("__at"), F.lit(3).alias("__CELL"), F.lit(4).alias("slot"))
    out = sharding.shuffle_into_shards(df, 3)
    assert out.columns == ["id", "__at", "__CELL", "slot", "shard"] and sorted((r["id"], r["__at"], r["__CELL"]) for r in out.collect()) == [(i, 2, 3) for i in range(30)]


def test_query_deals_whole_documents_and_digests_what_comes_out(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    passed = []

    def shuffle(df, shards):
        passed.append(df.columns)
        return sharding.shuffle_into_shards(df, shards).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!")))

    monkeypatch.setattr(queries, "shuffle_into_shards", shuffle)
    out = queries.op1_sharding(spark, sf_dir).collect()
    assert passed == [docs.columns]
    texts = [((r.text or "") + "!").encode() for r in docs.collect()]
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len(t) + 1, zlib.crc32(t)) for t in texts)
