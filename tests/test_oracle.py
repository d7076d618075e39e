"""Every registered query against DuckDB on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from tessella import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.oracle_sql():
        return
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert found == expected


def test_flagship(spark, small):
    import __spark_entry__

    ranked = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) == 100
    assert [r["final_score"] for r in ranked] == sorted((r["final_score"] for r in ranked), reverse=True)
