"""Every registered query with SQL against DuckDB; the others for rows."""

import math
import os

import duckdb
import pytest

from plumbline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    if isinstance(x, str):
        return x
    x = float(x)
    return "nan" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert columns
        return
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got
