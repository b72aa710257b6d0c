"""Every core query with SQL gives what DuckDB gives on the smallest tables, and every core query stands empty tables."""

import glob
import math
import os

import pytest

from quillspark import catalog

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return None if math.isnan(v) else round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, TABLES)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(x) for x in r)) for r in df.select(*cols).collect())
    r = duck.sql(catalog.oracle_sql()[name])
    at = [r.columns.index(c) for c in cols]
    assert sorted(r.columns) == cols
    assert got == sorted(repr(tuple(norm(row[i]) for i in at)) for row in r.fetchall())


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    import pyarrow.parquet as pq

    at = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{TABLES}/*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), at / os.path.basename(f))
    return str(at)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_on_empty_tables(spark, empty, name):
    catalog.queries()[name](spark, empty).collect()
