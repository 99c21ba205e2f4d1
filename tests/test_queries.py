"""Every registered query of the base library against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from gleanwork.plans import editorial, evidence, intake, newsroom, relational, scalars

QUERIES = scalars.QUERIES | relational.QUERIES | evidence.QUERIES | newsroom.QUERIES | editorial.QUERIES | intake.QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v.isoformat() + "T00:00:00" if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, db, name):
    query, sql = QUERIES[name]
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    if sql:
        cursor = db.execute(sql)
        order = [[c[0] for c in cursor.description].index(n) for n in names]
        assert got == sorted(repr(tuple(plain(r[k]) for k in order)) for r in cursor.fetchall())


def test_registry():
    import __spark_entry__ as entry

    parts = (scalars, relational, evidence, newsroom, editorial, intake)
    assert len(QUERIES) == sum(len(p.QUERIES) for p in parts)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
