"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from millrace import queries as Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{D}/{n}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind in "iub":
            df = df.assign(**{c: df[c].astype(float)})
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    a, b = Q.QUERIES[name](spark, D).toPandas(), con.execute(Q.ORACLE_SQL[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    got, want = rows(a), rows(b)
    assert len(got) == len(want)
    bad = [(x, y) for x, y in zip(got, want, strict=True) if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-4 * max(1, abs(q)) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
