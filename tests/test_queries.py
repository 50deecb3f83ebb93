"""Every registered query against its SQL, over whole tables, and what its plan may not contain."""

import math
import re

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

TABLES = "documents pages events conversations labels benchmark".split()
from docsync.plans.oracles import ORACLES  # noqa: E402
from docsync.plans.queries import QUERIES  # noqa: E402

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def test_every_query_has_sql_and_is_registered():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|MapInPandas|FlatMapGroups", plan)
    relation = duck.sql(ORACLES[name])
    assert sorted((c, TYPES[t]) for c, t in df.dtypes) == sorted(zip(relation.columns, map(str, relation.types)))
    got, expected = table(df.columns, df.collect()), table(relation.columns, relation.fetchall())
    assert len(expected) > 0
    assert got == expected


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_key", "title", "lang", "score"] and df.count() == 20
