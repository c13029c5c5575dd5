"""The numbered queries against DuckDB on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from textlab.llm import oracle, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(oracle.SQL[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF).select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_all_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(oracle.SQL) <= set(entry.oracle_sql())
