"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as entry

QUERIES = entry.own_queries()
ORACLE = {name: entry.oracle_sql()[name] for name in QUERIES}
SF_DIR = "/root/testdata/sf0.001"

TYPES = {
    "BIGINT": "bigint",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert spark_rows(frame) == duck_rows(con, ORACLE[name])
    described = con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()
    expected = {row[0]: TYPES[row[1]] for row in described}
    assert {f.name: f.dataType.simpleString() for f in frame.schema} == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 7
