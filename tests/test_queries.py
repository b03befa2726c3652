"""Every registered query of the core against its DuckDB text."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from claimworks.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame):
    cell = lambda v: "NULL" if v is None or v is pd.NaT or isinstance(v, float) and v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = core.QUERIES[name](spark, sf_dir).toPandas()
    if name not in core.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.QUERIES) <= set(entry.queries())
