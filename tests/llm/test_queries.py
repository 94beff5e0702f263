"""The queries with SQL against DuckDB on the smallest test tables."""

from pathlib import Path

import pytest

from lumenlake.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, str(DATA))
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=str) == want and want
