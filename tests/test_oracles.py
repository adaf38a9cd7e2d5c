"""Every core query agrees with its SQL on the smallest tables."""
import datetime
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("OPWEAVE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

import __spark_entry__ as entry  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})").fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["session_id", "kind", "start_ms", "end_ms"]
