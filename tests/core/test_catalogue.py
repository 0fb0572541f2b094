"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest
from conftest import SMALL

from chronolith.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = db.sql(catalogue.ORACLES[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted(map(tuple, got.select(names).collect()), key=key)
    right = sorted(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall(), key=key)
    assert left and left == right


def test_flagship(spark):
    assert catalogue.flagship(spark, SMALL).count() > 0
