"""Every query with SQL returns the rows of that SQL; the others return rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from inkling.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if type(v).__name__ in ("float", "Decimal"):
        return None if math.isnan(v) else float(f"{float(v):.7g}")
    return v


def rows(names, records):
    return sorted(repr([plain(r[n]) for n in sorted(names)]) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    if name not in catalog.SQL:
        assert got
        return
    relation = duck.execute(catalog.SQL[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, got) == rows(names, [dict(zip(names, r)) for r in relation.fetchall()])
