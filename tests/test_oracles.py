"""Every registered graph query against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import SF
from weftgraph.plans import registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return "null" if pd.isna(x) else str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted("|".join(plain(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
