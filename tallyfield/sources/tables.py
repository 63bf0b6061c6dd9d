"""Readers that flatten payloads of price-level feeds, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month names of the labels "1988 JAN".
MONTHS = {m: i for i, m in enumerate(["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"], 1)}


def _month(period: Column) -> Column:
    return F.try_to_date(F.concat(period, F.lit("-01")))


def read_cpi_json(spark, path: str) -> DataFrame:
    """(country_code, month, cpi) of documents {country_code, data: [{period, cpi}]}; null values go."""
    docs = spark.read.schema("country_code string, data array<struct<period: string, cpi: double>>").json(path, multiLine=True)
    return docs.select("country_code", F.explode("data").alias("d")).select("country_code", _month(F.col("d.period")).alias("month"), F.col("d.cpi").alias("cpi")).where("cpi is not null and month is not null")


def flatten_sdmx(df: DataFrame, payload: str, start_year: int) -> DataFrame:
    """(series, period, value) of {series: {key: {observations: {"k": [v]}}}, times: [...]} from a start year on."""
    x = F.from_json(payload, "series map<string, struct<observations: map<string, array<double>>>>, times array<string>")
    out = df.select(x.alias("x")).select(F.explode("x.series").alias("series", "s"), F.col("x.times").alias("times"))
    out = out.select("series", "times", F.explode("s.observations").alias("k", "v")).select("series", F.try_element_at("times", (F.col("k").cast("int") + 1)).alias("period"), F.col("v")[0].alias("value"))
    return out.where(F.col("value").isNotNull() & (F.left("period", F.lit(4)).cast("int") >= start_year))


def parse_month_label(df: DataFrame, label: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys..., month, value) of labels like 1988 JAN; only positive numbers."""
    from tallyfield.functions.columns import lookup

    part = F.split(F.trim(F.upper(label)), " +")
    month = F.make_date(part[0].try_cast("int"), lookup(F.try_element_at(part, F.lit(2)), MONTHS), F.lit(1))
    return df.select(*(keys or []), month.alias("month"), F.col(value).try_cast("double").alias("value")).where("month is not null and value > 0")


def pivot_divisions(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long (keys..., month, division, value) to one row a month: overall as cpi_value, 01 as cpi_food."""
    return df.groupBy(*(keys or []), "month").pivot("division", ["overall", "01"]).agg(F.max("value")).withColumnsRenamed({"overall": "cpi_value", "01": "cpi_food"})


def flatten_pair_payload(df: DataFrame, payload: str) -> DataFrame:
    """(key, month, value) of [meta, rows] payloads with annual rows, dated January; null values go."""
    rows = F.from_json(F.get_json_object(payload, "$[1]"), "array<struct<country: struct<id: string>, date: string, value: double>>")
    return df.select(F.explode(rows).alias("r")).select(F.col("r.country.id").alias("key"), F.make_date(F.col("r.date").try_cast("int"), F.lit(1), F.lit(1)).alias("month"), F.col("r.value").alias("value")).where("value is not null and month is not null")


def decode_keyed_content(df: DataFrame, payload: str) -> DataFrame:
    """Mean value by month of a map whose keys end in YYYYMM."""
    out = df.select(F.explode(F.from_json(payload, "map<string, double>")).alias("k", "v"))
    return out.withColumn("month", F.try_to_date(F.concat(F.regexp_extract("k", "(\\d{6})$", 1), F.lit("01")), "yyyyMMdd")).where("month is not null").groupBy("month").agg(F.avg("v").alias("value"))


def load_reference_csv(spark, path: str, roster: DataFrame, number: list[str]) -> DataFrame:
    """Rows of a CSV whose iso3 is in the roster, dates cut to the day, numbers or null; rows without a date go."""
    df = spark.read.csv(path, header=True)
    out = df.withColumn("date", F.try_to_date(F.left("date", F.lit(10)))).withColumns({c: F.col(c).try_cast("double") for c in number})
    return out.where("date is not null").join(roster, "iso3", "left_semi")


def resolve_rates(snapshots: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One rate a currency of snapshots(currency, rate, kind, at): a cache of under `hours`, fetched, an old cache, then constants."""
    fresh = (F.col("kind") == "cache") & (F.unix_micros(now) - F.unix_micros("at") < hours * 3_600_000_000)
    rank = F.when(fresh, 0).when(F.col("kind") == "fetched", 1).when(F.col("kind") == "cache", 2).otherwise(3)
    order = Window.partitionBy("currency").orderBy("_r", F.desc_nulls_last("at"), "rate")
    return snapshots.withColumn("_r", rank).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("currency", "rate")


def rate_versions(snapshots: DataFrame, hours: int = 24) -> DataFrame:
    """(currency, since, until, rate) of snapshots(currency, rate, kind, at): which rate holds from when to when.

    At any moment the latest cached rate holds while it is under `hours` old, else the latest fetched
    one, else the latest cached one however old, else the constant. So a rate can change where a
    snapshot was taken and where a cached one grows old; the first version of a currency with a
    constant begins at the beginning of time (since null), the last of all ends never (until null).
    Of several snapshots of a currency, kind and moment the smallest rate counts. Snapshots are few
    beside the rows that they are applied to: one small series a currency.
    """
    micros = F.unix_micros("at")
    taken = snapshots.where("kind in ('cache', 'fetched') and at is not null and currency is not null").groupBy("currency", "kind", micros.alias("m")).agg(F.min("rate").alias("rate"))
    fixed = snapshots.where("kind = 'constant' and currency is not null").groupBy("currency").agg(F.min("rate").alias("fixed"))
    point = F.when(F.col("kind") == "cache", F.array(F.col("m"), F.col("m") + hours * 3_600_000_000)).otherwise(F.array("m"))
    points = taken.select("currency", F.explode(point).alias("since")).unionByName(fixed.select("currency", F.lit(None).cast("long").alias("since"))).distinct()
    seen = points.join(taken.select("currency", F.col("m").alias("since"), "kind", "rate").groupBy("currency", "since").pivot("kind", ["cache", "fetched"]).agg(F.min("rate")), ["currency", "since"], "left")
    w = Window.partitionBy("currency").orderBy(F.asc_nulls_first("since"))
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = seen.withColumns({"c": last("cache"), "c_at": last(F.when(F.col("cache").isNotNull(), F.col("since"))), "f": last("fetched"), "until": F.lead("since").over(w)}).join(fixed, "currency", "left")
    fresh = F.col("since") - F.col("c_at") < hours * 3_600_000_000
    return rows.select("currency", "since", "until", F.coalesce(F.when(fresh, F.col("c")), "f", "c", "fixed").alias("rate")).withColumns({c: F.timestamp_micros(c) for c in ("since", "until")})


def rates_as_of(rows: DataFrame, versions: DataFrame, time: str, currency: str = "currency") -> DataFrame:
    """rows with the rate that held at their time (null without any): versions are cut at the months that the rows span and meet them by currency and month."""
    own = rows.withColumn("_at", F.col(time).cast("timestamp")).withColumn("_month", F.trunc("_at", "MM"))
    span = own.agg(F.min("_month").alias("first"), F.max("_month").alias("last"))
    cut = versions.crossJoin(F.broadcast(span)).where("first is not null")  # one row
    since, until = F.greatest(F.trunc("since", "MM"), F.col("first")), F.least(F.trunc("until", "MM"), F.col("last"))
    cut = cut.withColumns({"_a": since, "_z": until}).where("_a <= _z").withColumn("_month", F.explode(F.expr("sequence(_a, _z, interval 1 month)")))
    cut = cut.select(F.col("currency").alias("_currency"), "_month", "since", "until", F.col("rate").alias("rate"))
    holds = (own[currency] == cut["_currency"]) & (own["_month"] == cut["_month"]) & (cut["since"].isNull() | (own["_at"] >= cut["since"])) & (cut["until"].isNull() | (own["_at"] < cut["until"]))
    return own.join(cut, holds, "left").select(*(own[c] for c in rows.columns), "rate")


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces a derived table whole, so that months that vanished upstream vanish here."""
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)
