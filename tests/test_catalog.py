"""Every registered query of the grammar operators against its SQL in DuckDB."""

import duckdb
import pytest

from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in catalog.SQL:
        assert rows
        return
    expected = duck.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({catalog.SQL[name]})").fetchall()
    assert rows == sorted(map(repr, expected))
