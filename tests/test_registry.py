"""Every registered query of the engine against DuckDB on the small tables, and its schema without rows where there is no SQL."""

import glob
from pathlib import Path

import duckdb
import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {Path(p).stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name in registry.oracle_sql():
        rel = db.sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        assert got == sorted(tuple(map(str, r)) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert got == sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() == 10
