"""Every query of the catalogue against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from graphloom.plans import augmenting, building, catalog, more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(repr(tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con.execute(f"CREATE OR REPLACE TEMP TABLE o AS {catalog.ORACLES[name]}")
    assert sorted(r[0] for r in con.execute("DESCRIBE o").fetchall()) == columns
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM o").fetchall()
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want)


def test_queries_without_sql_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, SF).columns, name
