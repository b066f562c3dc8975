"""Every query of the subpackage that SQL expresses, against that SQL."""

import os

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = con.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected
