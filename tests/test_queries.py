"""Every query against its oracle at the smallest scale."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert rows
        return
    got = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall()), key=repr)
    assert rows == expected
