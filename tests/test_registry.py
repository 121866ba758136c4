"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as driver

ANSWERS = driver.oracle_sql()
QUERIES = driver.queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    cursor = duck.execute(ANSWERS[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert columns == sorted(kinds)
    assert {c: TYPES[t] for c, t in frame.dtypes} == {c: kinds[c].replace("NUMBER", "DOUBLE") for c in columns}
    names = [d[0] for d in cursor.description]
    expected = [tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in cursor.fetchall()]
    found = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    assert ordered(found) == ordered(expected)
    assert found


def test_only_the_file_catalog_has_no_sql(spark):
    own = {name for name in QUERIES if name != "pipeline" and not name.startswith("op")}
    assert own - set(ANSWERS) == {"s1_document_catalog"}
    rows = QUERIES["s1_document_catalog"](spark, DATA).collect()
    assert {"orders.parquet", "documents.parquet"} <= {r.filename for r in rows}


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert sum(r.documents for r in rows) == 1500


@pytest.mark.parametrize("name", ["x7_fallback_report", "v1_field_dispatch"])
def test_costly_rows_are_dealt_to_all_partitions(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan, plan
