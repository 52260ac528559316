"""Every registered query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

from checks import oracle, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")

    def text(v):
        if v is None:
            return "\0"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = df.astype(object).where(df.notna(), None).itertuples(index=False)
    return sorted(tuple(map(text, r)) for r in rows)


def test_every_query_has_a_statement():
    assert set(registry.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan
    ours = df.toPandas()
    theirs = duck.execute(oracle.statement(name)).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
