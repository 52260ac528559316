"""Every text query that has a DuckDB statement, against it, on the smallest tables."""

import duckdb
import pytest

from shelfwise.llm import oracle, queries
from tests.test_oracle import FOLDER, canonical


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(oracle.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_names():
    numbers = sorted(int(q.split("_")[0].removeprefix("op")) for q in queries.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) >= 10
    assert set(oracle.SQL) <= set(queries.QUERIES)
