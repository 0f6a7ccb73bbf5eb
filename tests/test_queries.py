"""Every registered query against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as spark_entry
from oreweave.plans import registry
from oreweave.tables import TABLE_NAMES

spark_entry.queries()  # imports the modules that register
PLANS, SQL = registry.PLANS, registry.SQL


def _value(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(PLANS) == set(SQL)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_equals_sql(spark, duck, small_dir, name):
    df = PLANS[name](spark, small_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_value, row)) for row in df.select(*columns).collect())
    relation = duck.sql(SQL[name])
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    expected = sorted(tuple(_value(row[i]) for i in order) for row in relation.fetchall())
    assert got == expected


def test_entry_runs(spark):
    assert spark_entry.entry(spark).columns == ["chunk_id", "vector_score", "keyword_score", "score"]
