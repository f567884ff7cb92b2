import duckdb
import pytest

import __spark_entry__ as e
from plumbline.llm import queries

SF = "/root/testdata/sf0.01"


def test_one_query_of_each_operator():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 11)) and "pipeline" in e.queries()
    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.ORACLES) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert got == sorted(want.fetchall()) and got
