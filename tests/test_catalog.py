"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomgraph.plans import catalog, catalog_more  # noqa: F401 (registers its queries)
from loomgraph.plans.projection import Tables

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


def tidy(x):
    return (None if math.isnan(x) else float(f"{x:.9g}")) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def shared(spark):
    """Edges, paths and holdings are made once for all queries."""
    return Tables(spark, DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(shared, name):
    df = catalog.PLANS[name](shared)
    got = sorted(repr([tidy(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(catalog.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(repr([tidy(r[i]) for i in at]) for r in rel.fetchall())
