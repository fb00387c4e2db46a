"""Every registered query with SQL gives what DuckDB gives, on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from recallforge.plans import registered

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    return columns, frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck.execute(SQL[name]).df()
    assert plain(got)[0] == plain(want)[0]
    assert plain(got)[1].equals(plain(want)[1])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "score"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
