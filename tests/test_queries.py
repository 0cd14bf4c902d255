"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from pactline.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    cols = sorted(df.columns)
    text = lambda v: "~" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).replace(" 00:00:00", "")
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(con.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
