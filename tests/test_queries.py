"""Every query with SQL against that SQL, on the smallest test data."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from curvelake.core import queries as core
from curvelake.plans import further
from curvelake.plans import queries as plans

DATA = "/root/testdata/sf0.001"
KNOWN = core.ORACLE | plans.ORACLE | further.ORACLE
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test data is not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


def rows(frame, columns):
    def plain(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(KNOWN[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_entry_and_names():
    names = entry.queries()
    assert set(KNOWN) <= set(names) and set(entry.oracle_sql()) <= set(names)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
