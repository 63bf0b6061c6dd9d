"""Rates of feeds round as the SQL does."""

import duckdb
from pyspark.sql import functions as F

from tallyfield.catalog.feeds import _sixth


def test_six_digits_round_as_the_sql_does(spark):
    rows = spark.range(0, 20_000).select("id", (F.col("id") * 20 + 4.5).alias("total"))
    got = {r[0]: r[1] for r in rows.select("id", _sixth(1 + F.col("total") / 1e6)).collect()}
    want = dict(duckdb.sql("select i, round(1 + (i * 20 + 4.5::double) / 1e6, 6) from range(20000) t(i)").fetchall())
    assert got == want
