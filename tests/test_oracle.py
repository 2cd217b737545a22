"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of, type_family  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry_needs_no_session_and_is_complete():
    q = entry.queries()
    assert len(q) >= 250 and set(ORACLE) <= set(q)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    types = {c: type_family(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: type_family(f.dataType.simpleString()) for f in df.schema.fields} == types
    assert rows_of(df.columns, got) == rows_of(rel.columns, want)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
