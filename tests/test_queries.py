"""Every query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from driftloom.plans import catalog, checks
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES, SQL = catalog.queries(), checks.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)
    )


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    frame = QUERIES[name](spark, SMALL)
    cursor = database.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    expected = normal(cursor.fetchall(), names)
    assert expected, "the comparison would be empty"
    assert normal([tuple(r) for r in frame.collect()], frame.columns) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
