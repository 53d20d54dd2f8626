import importlib.util
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["book_id", "page", "snippet"] and df.count() >= 0


@pytest.mark.skipif(importlib.util.find_spec("duckdb") is None, reason="no DuckDB here")
def test_core_queries_equal_their_sql(spark):
    import duckdb

    from lectern import catalogue
    from oracle_check import rows_of

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    sql = catalogue.oracle_sql()
    for name, query in catalogue.queries().items():
        df = query(spark, SF)
        got = rows_of(df.columns, df.collect())
        if name in sql:
            cur = con.execute(sql[name])
            cols = [c[0] for c in cur.description]
            assert sorted(cols) == sorted(df.columns), name
            assert got == rows_of(cols, cur.fetchall()), name
