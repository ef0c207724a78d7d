"""Every SQL-checked registered query vs its DuckDB oracle on sf0.001."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    d_cols, d_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_every_query_has_a_callable():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 55


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["TARGET_MONTH", "PEAK_TYPE", "EID"]
    assert df.count() > 0


ROWS_ONLY = sorted(set(entry.queries()) - set(ORACLES))


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")
@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0
