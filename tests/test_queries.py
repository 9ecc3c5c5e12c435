"""Every registered query of the library against its SQL in DuckDB, over the smallest bundled tables."""

import os

import duckdb
import pytest

from cellflow.plans import registry
from cellflow.sources.io import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no bundled tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = oracle.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    text = lambda v: repr(v) if isinstance(v, float) else str(v)
    want = sorted([text(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert sorted([text(r[c]) for c in columns] for r in got.collect()) == want


def test_entry(spark):
    assert registry.entry(spark, FOLDER).columns[:3] == ["variant", "rows", "mae"]
