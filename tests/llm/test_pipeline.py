import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm.queries import ORACLES, QUERIES

from .test_neardup import brute


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_the_queries_are_whole(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_sharding", "op6_secrets", "op7_neardup", "op8_bpe"):
        assert QUERIES[name](spark, sf_dir).count() == n


def test_near_copies_of_the_small_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op7_neardup"](spark, sf_dir).collect())) == brute(docs)


def test_stages_one_after_the_other(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "decontamination", "secrets", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, sf_dir), name)
        assert after.columns == docs.columns
        had, has = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert has.keys() <= had.keys()
        if name == "neardup":
            classes = {c for _, c, _ in brute([(i, r.text) for i, r in had.items()])}
            assert has.keys() == classes
        if name == "secrets":
            assert has.keys() == had.keys()
            assert all(r.n_chars == len(r.text) for r in has.values())
            changed = [i for i in has if has[i].text != had[i].text]
            assert changed and all("[SECRET]" in has[i].text for i in changed)
        else:
            assert all(has[i] == had[i] for i in has)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count() and last.where(~F.col("round_trip")).count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()


def test_stages_on_odd_and_empty_documents(spark, sf_dir, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for some in (docs, docs.where(F.lit(False))):
        for name, stage in corpus_pipeline.STAGES:
            some = corpus_pipeline.materialize(stage(spark, some, sf_dir), name)
            some.count()
