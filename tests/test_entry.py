"""Every registered query against the same question in SQL, on the smallest tables."""

import math
import os
from collections import Counter
from glob import glob

import duckdb
import pytest

import __spark_entry__ as spark_entry
from entry_support import oracle, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def as_bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def test_each_query_has_sql():
    assert set(SQL) == set(registry.QUERIES)
    assert set(SQL) <= set(spark_entry.oracle_sql()) and set(registry.QUERIES) <= set(spark_entry.queries())


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, duck, capsys, key):
    df = registry.QUERIES[key](spark, SF_DIR)
    df.explain()
    plan = capsys.readouterr().out
    assert "Physical Plan" in plan and not [node for node in UNWANTED if node in plan]
    cursor = duck.execute(SQL[key])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert as_bag(df.columns, df.collect()) == as_bag(names, cursor.fetchall())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
