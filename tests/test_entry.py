"""Every query of the layout engine runs, and equals its DuckDB SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quire import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(found, columns, wanted):
    at = [columns.index(c) for c in wanted]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = df.collect()
    assert found or name in ("a19_dup_line_check",)
    if name in catalog.ORACLE_SQL:
        cursor = duck.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(found, df.columns, sorted(columns)) == rows(cursor.fetchall(), columns, sorted(columns))


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
