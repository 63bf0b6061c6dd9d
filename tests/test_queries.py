"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tallyfield import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df):
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return bool(v)
        if isinstance(v, str):
            return v
        try:
            return float(f"{float(v):.10g}") + 0.0  # ten digits, see close()
        except (TypeError, ValueError):
            return str(v)[:19].replace(" 00:00:00", "")

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=repr)


def close(a, b) -> bool:
    """Whether two sorted results are the same, numbers to a billionth of their size."""
    same = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y
    if a == b:
        return True
    # floats that differ in the last digits may sort apart: rows are paired by everything else first
    order = lambda rows: sorted(rows, key=lambda r: repr([x if not isinstance(x, float) else float(f"{x:.6g}") for x in r]))
    return len(a) == len(b) and all(all(map(same, x, y)) for x, y in zip(order(a), order(b), strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert close(plain(got), plain(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
