"""All registered queries against their SQL on DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_every_equivalent_has_its_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 120


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(plain(v) for v in row) for row in cursor.fetchall())
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    assert got == want


def test_entry(spark):
    rows = contract.entry(spark).limit(5).collect()
    assert rows and {"table", "hour", "events", "late_share", "top_priority"} <= set(rows[0].asDict())
