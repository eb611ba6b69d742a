"""The corpus queries that SQL can express, beside their SQL."""

import duckdb
import pytest

from millrace.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    q = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(q.fetchall())
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == tuple(pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in b)
