"""Registered queries against their SQL twins: some always, all with WARDLINE_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
import check

DATA = os.environ.get("WARDLINE_DATA", "/root/testdata/sf0.01")
SOME = ["suspicion_match", "sepsis_onset", "comorbidity_index", "one_row_per_entity", "reading_worst", "asof_latest_before", "window_sums",
        "group_quantiles", "auc", "model_frequency", "rollup_tree", "round_trip_csv", "read_opening_book"]
ALL = list(entry.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ALL if os.environ.get("WARDLINE_ALL") else SOME)
def test_query_equals_its_twin(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows(df.columns, got) == check.rows(cols, res.fetchall())


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(ALL) and len(ALL) > 150


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
