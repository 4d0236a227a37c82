"""Every core query against its plain SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith(("p6", "p7", "p8"))]


def norm(rows):
    return sorted((tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = norm(tuple(r[c] for c in cols) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = norm(tuple(dict(zip(names, r))[c] for c in cols) for r in res.fetchall())
    assert got == want


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
