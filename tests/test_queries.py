"""Every query with an oracle, against DuckDB on the smallest tables; those without run and return rows."""

import os

import duckdb
import pytest

from millrace.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"hyperparameter_search", "rff_svm", "linear_svm", "zero_cross_bandpass"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda row: tuple(repr(x + 0.0) if isinstance(x, float) else repr(x) for x in row)
    assert sorted(key(r) for r in df.select(*order).collect()) == sorted(key([r[names.index(c)] for c in order]) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
