"""Queries over feeds: payloads and files that are made from the price-level view are read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import lookup
from tallyfield.sources import tables

from .base import _LIST, _RATE, CURRENCIES, Tables, query, sql

_SEEN = "not (extract(month from month) = 7 and country like '%3')"


def _cpi(t: Tables) -> DataFrame:
    """The price-level view with its values to four places, some of them missing."""
    seen = ~((F.month("month") == 7) & F.col("country").endswith("3"))
    return t.cpi.select("country", "month", F.when(seen, F.round("cpi", 4)).alias("cpi"))


@query("read_cpi_json", sql("cpi", f"select country as country_code, strftime(month, '%Y-%m') as month, round(cpi, 4) as cpi from cpi where {_SEEN}"))
def _(t: Tables) -> DataFrame:
    """A document per country, each in a file of its own."""
    data = F.array_sort(F.collect_list(F.struct(F.date_format("month", "yyyy-MM").alias("period"), "cpi"))).alias("data")
    docs = _cpi(t).groupBy(F.col("country").alias("country_code")).agg(data)
    docs.select(F.to_json(F.struct("country_code", "data"), {"ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).text(folder := t.folder())
    return tables.read_cpi_json(t.spark, folder).withColumn("month", F.date_format("month", "yyyy-MM"))


@query("flatten_sdmx", sql("cpi", f"select country as series, strftime(month, '%Y-%m') as period, round(cpi, 4) as value from cpi where {_SEEN} and extract(year from month) >= 1994"))
def _(t: Tables) -> DataFrame:
    """One payload: series by key, observations by position in a shared list of periods; ragged series and null observations."""
    months = _cpi(t).select(F.date_format("month", "yyyy-MM").alias("period")).distinct().agg(F.array_sort(F.collect_list("period")).alias("times"))
    rows = _cpi(t).crossJoin(F.broadcast(months))  # one row
    at = (F.array_position("times", F.date_format("month", "yyyy-MM")) - 1).cast("string")
    series = rows.groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct(at, F.array("cpi")))).alias("observations"), F.first("times").alias("times"))
    payload = series.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("country", F.struct("observations")))).alias("series"), F.first("times").alias("times"))
    return tables.flatten_sdmx(payload.select(F.to_json(F.struct("series", "times"), {"ignoreNullFields": "false"}).alias("p")), "p", 1994)


@query("flatten_pair_payload", sql("cpi", f"select country as key, extract(year from month) || '-01' as month, round(avg(round(cpi, 4)) filter ({_SEEN}), 4) as value from cpi group by country, extract(year from month) having count(*) filter ({_SEEN}) >= 12"))
def _(t: Tables) -> DataFrame:
    """A payload [meta, rows] for each country with annual means, null where a month is missing."""
    year = _cpi(t).groupBy("country", F.year("month").cast("string").alias("date")).agg(F.when(F.count("cpi") >= 12, F.round(F.avg("cpi"), 4)).alias("value"))
    rows = year.groupBy("country").agg(F.collect_list(F.struct(F.struct(F.col("country").alias("id")).alias("country"), "date", "value")).alias("rows"))
    payload = F.concat(F.lit('[{"page":1},'), F.to_json("rows", {"ignoreNullFields": "false"}), F.lit("]"))
    return tables.flatten_pair_payload(rows.select(payload.alias("p")), "p").withColumn("month", F.date_format("month", "yyyy-MM"))


@query("parse_month_label", sql("cpi", "select country, strftime(month, '%Y-%m') as month, round(cpi, 4) as value from cpi"))
def _(t: Tables) -> DataFrame:
    """Labels such as 1988 JAN beside numbers as text; sums over months that can't be read, such as a year alone, go."""
    label = F.concat(F.year("month"), F.lit(" "), F.upper(F.date_format("month", "MMM")))
    rows = t.cpi.select("country", label.alias("label"), F.col("cpi").cast("string").alias("v"))
    rows = rows.unionByName(t.cpi.select("country", F.year("month").cast("string").alias("label"), F.lit("1").alias("v"))).unionByName(t.cpi.select("country", label.alias("label"), F.lit("-").alias("v")))
    return tables.parse_month_label(rows, "label", "v", ["country"]).select("country", F.date_format("month", "yyyy-MM").alias("month"), F.round("value", 4).alias("value"))


@query("pivot_divisions", sql("cpi", "select country, strftime(month, '%Y-%m') as month, round(cpi, 4) as cpi_value, round(food, 4) as cpi_food from cpi"))
def _(t: Tables) -> DataFrame:
    """All countries: the overall level and its food part as divisions of a long table, and a division that nothing asks for."""
    long = t.cpi.select("country", "month", F.inline(F.array(*(F.struct(F.lit(d).alias("division"), v.alias("value")) for d, v in (("overall", F.round("cpi", 4)), ("01", F.round("food", 4)), ("07", F.lit(1.0)))))))
    return tables.pivot_divisions(long, ["country"]).withColumn("month", F.date_format("month", "yyyy-MM"))


@query("load_reference_csv", sql("cpi", "select country as iso3, strftime(month, '%Y-%m-%d') as date, case when extract(month from month) <> 5 then round(cpi, 4) end as price from cpi where country like '%1' or country like '%2'"))
def _(t: Tables) -> DataFrame:
    """A CSV file with times behind dates, numbers that are none, and rows without a date; countries by a roster."""
    price = F.when(F.month("month") == 5, "n/a").otherwise(F.col("cpi").cast("string"))
    rows = t.cpi.select(F.col("country").alias("iso3"), F.concat(F.col("month").cast("string"), F.lit("T00:00")).alias("date"), price.alias("price"))
    rows.unionByName(t.cpi.select(F.col("country").alias("iso3"), F.lit("unknown").alias("date"), F.lit("1").alias("price"))).write.csv(folder := t.folder(), header=True)
    roster = t.read("nation").select(F.col("n_name").alias("iso3")).where("iso3 like '%1' or iso3 like '%2'")
    return tables.load_reference_csv(t.spark, folder, roster, ["price"]).select("iso3", F.col("date").cast("string").alias("date"), F.round("price", 4).alias("price"))


@query("overwrite_table", sql("cpi", "select country, strftime(month, '%Y-%m') as month, round(cpi, 4) as cpi from cpi where month >= date '1995-01-01'"))
def _(t: Tables) -> DataFrame:
    """A derived table written whole, then without its older months."""
    rows, path = t.cpi.select("country", F.date_format("month", "yyyy-MM").alias("month"), F.round("cpi", 4).alias("cpi")), t.folder()
    tables.overwrite(rows, path)
    tables.overwrite(rows.where("month >= '1995-01'"), path)
    return t.spark.read.parquet(path)


@query("export_csv", sql("idx", "select country, strftime(month, '%Y-%m') as month, round(combined_index, 4) as combined_index, item_count from idx"))
def _(t: Tables) -> DataFrame:
    rows = t.median_index.select(F.date_format("month", "yyyy-MM").alias("month"), "country", F.round("combined_index", 4).alias("combined_index"), "item_count", "coverage_note")
    tables.export_csv(rows, ["country", "month", "combined_index", "item_count"], path := t.folder())
    return t.spark.read.csv(path, header=True, schema="country string, month string, combined_index double, item_count long")


def _sixth(x: Column) -> Column:
    """x to six digits as the SQL has it: the double times a million is rounded, not the number that its digits say, which differs at halves."""
    return F.round(x * 1e6) / 1e6


def _snapshots(t: Tables) -> DataFrame:
    """Rates as orders have them: urgent ones count as cached, high ones as fetched, at the order's day; and constants for all but two currencies."""
    df = t.read("orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    currency = F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.col("c_nationkey") % len(CURRENCIES) + 1).cast("int"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "cache").otherwise("fetched")
    taken = df.select(currency.alias("currency"), _sixth(1 + F.col("o_totalprice") / 1e6).alias("factor"), kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"))
    taken = taken.select("currency", (lookup("currency", params.RATES) * F.col("factor")).alias("rate"), "kind", "at")
    fixed = t.spark.createDataFrame([(c, float(params.RATES[c])) for c in CURRENCIES[2:]], "currency string, rate double")
    return taken.unionByName(fixed.select("currency", "rate", F.lit("constant").alias("kind"), F.lit(None).cast("timestamp").alias("at")))


@query("rates_by_day", sql("raw", f""", days as (select distinct currency, collection_date as d from raw union select currency, date '1901-01-01' from raw),
snap as (select currency, kind, o_orderdate as taken, cast({_RATE} as double) * min(factor) as rate from (select {_LIST(CURRENCIES)}[c_nationkey % 11 + 1] as currency, case when o_orderpriority = '1-URGENT' then 'cache' else 'fetched' end as kind, o_orderdate, round(1 + o_totalprice / 1e6, 6) as factor
  from orders join customer on o_custkey = c_custkey where o_orderpriority in ('1-URGENT', '2-HIGH')) group by currency, kind, o_orderdate),
c as (select d.*, s.rate as cached, s.taken from days d asof left join (select * from snap where kind = 'cache') s on d.currency = s.currency and d.d >= s.taken),
f as (select c.*, s.rate as fetched from c asof left join (select * from snap where kind = 'fetched') s on c.currency = s.currency and c.d >= s.taken)
select currency, cast(d as varchar) as day, round(coalesce(case when d - interval 1 day < taken then cached end, fetched, cached, case when currency not in ('{CURRENCIES[0]}', '{CURRENCIES[1]}') then cast({_RATE} as double) end), 6) as rate from f"""))
def _(t: Tables) -> DataFrame:
    """The rate of every currency on each of its observations' days, and on a day before all snapshots."""
    days = t.observations.select("currency", F.col("collection_date").alias("day")).distinct()
    days = days.unionByName(days.select("currency", F.lit("1901-01-01").cast("date").alias("day")).distinct())
    out = tables.rates_as_of(days, tables.rate_versions(_snapshots(t)), "day")
    return out.select("currency", F.col("day").cast("string").alias("day"), _sixth(F.col("rate")).alias("rate"))
