import duckdb
import pytest

from rillstone.llm.queries import ORACLE_SQL, QUERIES

from . import cases


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    got = QUERIES[name](spark, cases.SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{cases.SF}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
