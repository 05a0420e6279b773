"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import os

import duckdb
import pytest

from quillspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "tzinfo") and value.tzinfo:
        value = value.replace(tzinfo=None)
    if isinstance(value, (int, float)) or type(value).__name__ in ("Decimal", "int64", "int32", "float64"):
        return round(float(value), 4) + 0.0
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(normal(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    query = catalog.QUERIES[name]
    got = query.run(spark, sf)
    rows = got.collect()
    if query.sql is None:
        assert rows
        return
    found = duck.execute(query.sql)
    want = table_of([c[0] for c in found.description], found.fetchall())
    have = table_of(got.columns, rows)
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    assert have[1] == want[1]
