"""A sample of the registered queries against their SQL; the driver runs them all."""

import os

import duckdb
import pytest

from stratograph.plans import all_queries, all_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["f04_find_references", "f05_find_implementations", "a01_fan_in_fan_out", "g14_dependency_tree", "g17_conductance", "a10_module_quality", "x01_cyclomatic", "x05_nesting_depth", "x36_cross_references", "a21_readability", "v03_top_k", "q08_get_or_create_id", "c07_history_batches", "i01_polling_changes"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    got = all_queries()[name](spark, SF)
    want = duck.execute(all_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    a = sorted((tuple(plain(v) for v in r) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_sql_names_a_query():
    assert set(all_sql()) <= set(all_queries())
