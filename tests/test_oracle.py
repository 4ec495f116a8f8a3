"""Every query against its SQL in DuckDB, all rows and columns compared."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from wrenchwork.plans import oracle, queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Those of the package for training text have tests of their own.
QUERIES = {name: query for name, query in driver.queries().items() if name in queries.QUERIES}
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in oracle.SQL}

# DuckDB's names for the types Spark returns.
KINDS = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN",
    "date": "DATE", "double": "DOUBLE",
}


# A third of all rows on one order, part, customer or user; and keys without a partner.
HOT_AND_ORPHANED = {
    "orders": """select * replace (case when o_orderkey % 3 = 0 then 7
        when o_orderkey % 50 = 1 then -5 else o_custkey end as o_custkey) from orders""",
    "lineitem": """select * exclude (rn) replace (
        case when rn % 3 = 0 then 8 when rn % 50 = 1 then -5 else l_orderkey end as l_orderkey,
        case when rn % 3 = 1 then 9 when rn % 50 = 2 then -5 else l_partkey end as l_partkey,
        case when rn % 50 = 3 then -5 else l_suppkey end as l_suppkey)
        from (select *, row_number() over () as rn from lineitem)""",
    "events": """select * replace (case when event_id % 3 = 0 then 7
        when event_id % 50 = 1 then -5 else user_id end as user_id) from events""",
    "documents": """select * replace (case when doc_id % 9 = 0 then null
        when doc_id % 9 = 1 then text || ' <a href="x">''&amp;''</a>' else text end as text)
        from documents""",
}


def connect(folder, tables=TABLES):
    connection = duckdb.connect()
    for name in tables:
        connection.execute(
            f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')"
        )
    return connection


@pytest.fixture(scope="module")
def given():
    with connect(FOLDER) as connection:
        yield FOLDER, connection


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The tables with hot keys and orphans worked in, in files that several tasks can read."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    with connect(FOLDER) as connection:
        for name in TABLES:
            rows = HOT_AND_ORPHANED.get(name, f"select * from {name}")
            connection.execute(
                f"copy ({rows}) to '{folder}/{name}.parquet' (format parquet, row_group_size 4096)"
            )
    with connect(folder) as connection:
        yield folder, connection


# Joins as between tables of which none is small, and hot keys cut from small sizes on.
AS_IF_LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    # Several tasks before a join as well: what one task has written cannot be cut.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
    "spark.sql.files.maxPartitionBytes": "128k",
    "spark.sql.files.openCostInBytes": "1k",
}


@pytest.fixture
def as_if_large(spark):
    before = {name: spark.conf.get(name, None) for name in AS_IF_LARGE}
    for name, value in AS_IF_LARGE.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark, name, folder, connection):
    frame = QUERIES[name](spark, folder)
    result = connection.execute(SQL[name])
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(frame.columns) == sorted(columns)
    assert {c: KINDS[k] for c, k in frame.dtypes} == kinds
    expected = _rows(columns, result.fetchall())
    assert _rows(frame.columns, [tuple(r) for r in frame.collect()]) == expected
    return expected, frame._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, given, name):
    rows, _ = compare(spark, name, *given)
    assert rows or name == "part_search_literal"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_hot_and_orphaned_keys(spark, skewed, as_if_large, name):
    _, plan = compare(spark, name, *skewed)
    if name in CUT:
        assert "skew=true" in plan


# Queries in which at least one join was cut at a hot key.
CUT = {
    "warranty_check", "warranty_recommendation", "review_card", "claimed_parts",
    "shipments_with_claim", "scan_shipments", "writeoff_stock",
}
