"""Every registered query runs, and equals its SQL on DuckDB where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 5)
    return round(float(value), 5) if hasattr(value, "as_tuple") else value


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    frame = entry.queries()[name](spark, DATA)
    rows = frame.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = database.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert table(frame.columns, rows) == table(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
