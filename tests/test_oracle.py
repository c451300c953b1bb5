"""Every registered query that SQL can express against DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from aerolake import registry
from aerolake import registry_rules as _rules  # noqa: F401  it registers its queries
from aerolake import registry_views as _  # noqa: F401  so does this

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple("null" if pd.isna(v) else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)
