"""Each catalog query against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from millrace import catalog


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    q = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in q.fetchall())


def test_entry_works_without_the_corpus_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: ({}, {}))
    assert set(entry.queries()) == set(catalog.QUERIES) and entry.entry(spark).count() > 0


def test_the_splitter_cuts_the_whole_table(spark, sf):
    rows = catalog.QUERIES["splitter_ext_count_all"](spark, sf).groupBy("split_key").count().collect()
    assert sum(r["count"] for r in rows) == spark.read.parquet(f"{sf}/lineitem.parquet").count() and max(r["count"] for r in rows) == 1000
