"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pytest

from lotlight import plans

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.10g}"
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_twin(spark, duck, name):
    df = plans.QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    twin = duck.sql(plans.SQL[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in twin.fetchall())
