"""Each relational query against its SQL in DuckDB, which is written apart from the plans."""

import math
import os

import duckdb
import pytest

from codequarry.plans import registry
from codequarry.plans.adapter_sql import BASE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else round(float(x), 5)
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in BASE:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    expected = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(df.columns)
    made, wanted = rows_of(df.columns, df.collect()), rows_of(names, expected.fetchall())
    assert len(made) == len(wanted)
    assert made == wanted
