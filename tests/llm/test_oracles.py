import duckdb
import pytest

from strandlake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
