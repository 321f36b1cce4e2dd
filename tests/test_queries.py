"""Every registered query gives its oracle's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarry.plans.catalogue import ORACLES, QUERIES, flagship
from quarry.session import TABLES

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, oracle, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), oracle.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    got = flagship(spark, DATA).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) == 10
    assert all(a.score >= b.score for a, b in zip(got, got[1:], strict=False)) or len({r.doc_id for r in got}) == 10
