"""Tables that a dashboard reads: country summary, latest values, totals and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _latest(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.groupBy("country").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("month"))).alias(name))


def country_summary(results: DataFrame, index: DataFrame, cpi: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per country that the results, the index or the counts know, with what each of them and the CPI say.

    months_of_data and base_month are the index's; latest values are the newest that are there;
    a country without results has the status no_granger_data; counts it lacks are 0.
    """
    months = index.groupBy("country").agg(F.count(F.lit(1)).alias("months_of_data"), F.min("month").alias("base_month"))
    months = months.join(_latest(index, "combined_index", "latest_index"), "country")
    out = months.join(results, "country", "full_outer").join(counts, "country", "full_outer").join(cpi.groupBy("country").agg(F.max_by("cpi", "month").alias("latest_cpi")), "country", "left")
    zero = [c for c in ("months_of_data", *counts.columns) if c != "country" and not c.endswith("_mean")]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in zero} | {"status": F.coalesce("status", F.lit("no_granger_data"))})


def latest_values(index: DataFrame, cpi: DataFrame, counts: DataFrame, fallback: str = "mean-price fallback") -> DataFrame:
    """Per country the newest month with an index (else the newest month), its indices, the newest CPI and the change against exactly twelve months before.

    The change is null where either month's note says that the fallback stood in, or the older value is not positive.
    """
    rows = index.select("country", "month", "combined_index", "formal_index", "informal_index", F.coalesce("coverage_note", F.lit("")).contains(fallback).alias("stood_in"))
    last = rows.groupBy("country").agg(F.max_by(F.struct(*rows.columns[1:]), F.struct(F.col("combined_index").isNotNull(), F.col("month"))).alias("m")).select("country", "m.*")
    before = rows.select("country", F.add_months("month", 12).alias("month"), F.col("combined_index").alias("before"), F.col("stood_in").alias("stood_in_before"))
    out = last.join(before, ["country", "month"], "left").join(cpi.groupBy("country").agg(F.max_by("cpi", "month").alias("cpi")), "country", "left")
    out = out.join(counts.select("country", "formal_items", "informal_items"), "country", "left")
    yoy = F.when(~F.col("stood_in") & ~F.col("stood_in_before") & (F.col("before") > 0), F.round((F.col("combined_index") / F.col("before") - 1) * 100, 2))
    items = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("formal_items", "informal_items")]
    return out.select("country", "month", "combined_index", "formal_index", "informal_index", "cpi", yoy.alias("yoy_change_pct"), *items)


def totals(summary: DataFrame) -> DataFrame:
    """Items and months over all countries, and how many have a significant result."""
    items = F.sum(F.coalesce("formal_items", F.lit(0)) + F.coalesce("informal_items", F.lit(0)))
    return summary.agg(items.alias("items"), F.sum(F.coalesce("months_of_data", F.lit(0))).alias("months"), F.count_if(F.coalesce("significant", F.lit(False))).alias("significant"))


def index_lookup(series: DataFrame, country: str) -> DataFrame:
    """A country's rows by its name in any case; an unknown name gives none."""
    return series.where(F.lower("country") == country.strip().lower())


def targets_today(targets: DataFrame, prices: DataFrame, key: str, day) -> DataFrame:
    """Targets as proven or unproven by any price, with the day's rows and restaurants."""
    seen = prices.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("collection_date") == day).alias("rows_today"), F.count_distinct(F.when(F.col("collection_date") == day, F.col("restaurant_name"))).alias("restaurants_today"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows_today", "restaurants_today")]
    return targets.join(seen, key, "left").select(key, F.when(F.col("rows") > 0, "proven").otherwise("unproven").alias("status"), *zero)


def country_listing(summary: DataFrame, prices: DataFrame) -> DataFrame:
    """The published summary by country; if it is empty, (country, n_items, n_restaurants) counted from the prices, under the summary's columns.

    What a summary lacks, or the counts lack, is null. The prices are read only if the summary holds nothing.
    """
    counts = prices.where("country is not null").groupBy("country").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("restaurant_name").alias("n_restaurants"))
    some = summary.where("country is not null")
    return some if some.limit(1).count() else summary.limit(0).unionByName(counts, allowMissingColumns=True)
