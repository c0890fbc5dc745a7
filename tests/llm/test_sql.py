"""Operators that SQL expresses, on the small tables."""

import duckdb
import pytest

from driftloom.llm.queries import oracle_sql, queries
from tests.conftest import SMALL
from tests.test_queries import TABLES, normal


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    frame = queries()[name](spark, SMALL)
    cursor = connection.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert normal([tuple(r) for r in frame.collect()], frame.columns) == normal(cursor.fetchall(), names)
