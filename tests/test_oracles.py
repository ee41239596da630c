"""Every library query against its SQL on the smallest tables, and some on larger ones with more cases."""

import os

import duckdb
import pytest

from curatrix.plans.queries import ORACLES, QUERIES


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, clean.itertuples(index=False, name=None)))


def compare(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(want)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["q15b_plan_with_tags", "q22_dup_report", "q28_coll_groups", "q29_merge_children", "q32_health", "q36_tag_roundtrip"])
def test_query_matches_sql_on_larger_tables(spark, name):
    compare(spark, "/root/testdata/sf0.01", name)
