"""Every graph query against its SQL on the smallest tables."""

import duckdb
import pytest

from vertexloom.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, D)
    cols = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        assert rows == sorted((tuple(r) for r in rel.select(*cols).fetchall()), key=str)
    else:
        assert rows
