"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarryline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def written(value) -> str:
    """A value as text, whichever of the two libraries' types it has."""
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([written(v) for v in value])
    if pd.isna(value):
        return "null"
    if isinstance(value, (bool, np.bool_)) or not isinstance(value, (int, float, np.number)):
        return str(value)
    return f"{float(value):.12g}"


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(written, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
