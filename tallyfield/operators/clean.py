"""Cleaning of price observations: backfill, filters, caps and joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import col, lookup


def load_observations(prices: DataFrame, categories: DataFrame) -> DataFrame:
    """Prices above 0 with category, signals, language and confidence of their item, or OTHER, [], en and 0."""
    out = prices.where("price is not null and price > 0").join(categories, "item_name", "left")
    fill = {"category": "OTHER", "quality_signals": "[]", "language_detected": "en", "confidence": 0.0}
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def backfill_usd(df: DataFrame, rates: dict[str, float] = params.RATES, default: float | None = 1.0, strict: bool = False) -> DataFrame:
    """price_usd from price and the currency's rate where it is null (strict: null or 0).

    default is the rate of unknown currencies; without one they stay null. Not strict, rows at 0 or below go.
    """
    rate = lookup("currency", rates, default)
    missing = F.col("price_usd").isNull() | (F.col("price_usd") == 0) if strict else F.col("price_usd").isNull()
    out = df.withColumn("price_usd", F.when(missing, F.col("price") / rate).otherwise(F.col("price_usd")))
    return out if strict else out.where("price_usd > 0")


def unknown_currencies(df: DataFrame, rates: dict[str, float] = params.RATES) -> DataFrame:
    return df.select("currency").distinct().where(~F.col("currency").isin(list(rates)))


def usd_from_symbol(df: DataFrame, symbols: list[tuple[str, str]], by_country: dict[str, str], rates: dict[str, float] = params.RATES) -> DataFrame:
    """price_usd of price_local: the first symbol in the text decides the currency, else the country."""
    code = lookup("country", by_country)
    for symbol, currency in reversed(symbols):
        code = F.when(F.col("currency_symbol").contains(symbol), currency).otherwise(code)
    return df.withColumn("currency", code).withColumn("price_usd", F.col("price_local") / lookup(F.col("currency"), rates))


def normalise_sector(df: DataFrame) -> DataFrame:
    """Both taxonomies as formal or informal; other sectors go."""
    names = {"formal": "formal", "informal": "informal", "chain": "formal", "independent": "informal"}
    return df.where(F.col("sector").isin(list(names))).withColumn("sector", lookup("sector", names))


def exclude_sources(df: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of other sources; a null source stays."""
    return df.where(~F.coalesce(F.col("source").isin(sources), F.lit(False)))


def quarantine(df: DataFrame, slices: list[tuple[str, str]]) -> DataFrame:
    """df without the (country, source) slices, which stay a small dimension."""
    slices = df.sparkSession.createDataFrame(slices, "country string, source string")
    return df.join(slices, ["country", "source"], "left_anti")


def cap_rows(df: DataFrame, keys: list[str], n: int, seed: str, unique: Column | str) -> DataFrame:
    """At most n rows of each key, the same at every run: those first by md5 of the row's key and a seed."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat(col(unique), F.lit(seed))), col(unique))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def drop_marked_names(df: DataFrame, name: str, markers: list[str]) -> DataFrame:
    return df.where(~F.lower(F.col(name)).rlike("|".join(map(re.escape, markers))))


def flag_unreadable(name: Column | str, internal: list[str]) -> Column:
    """Names that are only an id, hold characters of broken decoding, or are internal labels."""
    return col(name).rlike("^[0-9]+$|^[0-9a-f]{8,}$|\\uFFFD|Ã|â€") | F.lower(F.trim(col(name))).isin(internal)


def dedupe_items(df: DataFrame, page: str, place: str) -> DataFrame:
    """The first row of each (page, name, price to cents, currency), by place on the page."""
    order = Window.partitionBy(page, "item_name", F.round("price", 2), "currency").orderBy(place)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def largest_capture(captures: DataFrame, have: DataFrame) -> DataFrame:
    """Of each store (url without its query) the largest capture, ties by url; stores in have(store) go."""
    out = captures.withColumn("store", F.split("url", "\\?")[0])
    out = out.groupBy("store").agg(F.max(F.struct("length", "url")).alias("m"))
    return out.join(have, "store", "left_anti").select("store", "m.url", "m.length")


def price_bounds(df: DataFrame, bounds: dict[str, float], default: float) -> DataFrame:
    return df.where((F.col("price") > 0) & (F.col("price") < lookup("source", bounds, default)))


def merge_informal(prices: DataFrame, informal: DataFrame, countries: dict[str, str], month: str, currency: str | None = None) -> DataFrame:
    """prices with the usable image-derived rows added: processed, priced, named, of known countries, and new by (image, item); with `currency` rows without a currency get that one."""
    new = informal.where((F.col("processed") == 1) & (F.col("price_usd") > 0) & (F.trim("item_name") != "") & F.col("country_code").isin(list(countries)))
    new = new.select(
        F.col("image_filename").alias("source_image"), "item_name", F.col("price_local").alias("price"), "price_usd", lookup("country_code", countries).alias("country"),
        F.lit("informal").alias("sector"), F.coalesce("collection_date", F.lit(month)).alias("collection_date"),
    )
    if currency:
        known = informal.where(F.col("currency_symbol").isNotNull()).select(F.col("image_filename").alias("source_image"), "item_name", F.col("currency_symbol").alias("currency")) if "currency_symbol" in informal.columns else None
        new = new.withColumn("currency", F.lit(currency)) if known is None else new.join(known.dropDuplicates(["source_image", "item_name"]), ["source_image", "item_name"], "left").withColumn("currency", F.coalesce("currency", F.lit(currency)))
    new = new.dropDuplicates(["source_image", "item_name"]).join(prices.where("source_image is not null").select("source_image", "item_name"), ["source_image", "item_name"], "left_anti")
    return prices.unionByName(new, allowMissingColumns=True)


# joins


def unseen(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner; nulls never exclude each other."""
    return left.join(right.select(*on), on, "left_anti")


def unseen_representatives(df: DataFrame, known: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row for each value of the key that known lacks: of its rows the columns of the one that is first by `order`; a null key is no value."""
    rest = unseen(df.where(F.col(key).isNotNull()), known, [key])
    return rest.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("x")).select(key, "x.*")


def asof_previous(now: DataFrame, history: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """now with the value and time of the latest strictly earlier row of history per key (of several at that time the largest value)."""
    past = history.select(*keys, time, F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_past"), F.lit(1).alias("_kind"))
    rows = now.withColumn("_kind", F.lit(0)).unionByName(past, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_kind", "_past.v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last("_past", ignorenulls=True).over(w)).where("_kind = 0")
    return rows.select(*now.columns, F.col("_last.v").alias(f"previous_{value}"), F.col("_last.t").alias(f"previous_{time}"))


def asof_at_least(df: DataFrame, keys: list[str], time: str, bound: Column) -> DataFrame:
    """The newest row of each key that is not after the bound."""
    return df.where(F.col(time) <= bound).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), time).alias("_m")).select(*keys, "_m.*")


def first_match(left: DataFrame, right: DataFrame, on: str, pick: str) -> DataFrame:
    """left with the smallest `pick` of right per key."""
    return left.join(right.groupBy(on).agg(F.min(pick).alias(pick)), on, "left")


def key_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys only in a (removed) or only in b (added)."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("change", F.lit("removed")).unionByName(y.join(x, keys, "left_anti").withColumn("change", F.lit("added")))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of updates in place of those with equal keys."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def append_new(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target and those of updates whose key is new, the first by order of each."""
    first = updates.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in updates.columns if c not in keys]), order).alias("_m")).select(*keys, "_m.*")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(target.columns))


def prefer_source(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of each key's most preferred source that has any."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source")).cast("int")
    ranked = df.withColumn("_r", rank).where("_r > 0")
    return ranked.withColumn("_b", F.min("_r").over(Window.partitionBy(*keys))).where("_r = _b").drop("_r", "_b")


def within_range(events: DataFrame, references: DataFrame, keys: list[str], time: str, at: str, seconds: int) -> DataFrame:
    """Every pair of an event and a reference of the same keys with the event's `time` in the `seconds` up to and with the reference's `at`.

    Time is cut into buckets of that length: an event lies in one bucket and its references in the
    same or the next one, so each reference is sent to two and the pairs meet by an equi-join on keys
    and bucket; the exact bound is checked there. A key with very many rows is spread over its
    buckets. Rows with a null key or time have no partner; columns of the two sides must have
    different names, keys aside.
    """
    micros = seconds * 1_000_000
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / micros).cast("long")
    left = events.where(F.col(time).isNotNull()).withColumn("_bucket", bucket(time))
    right = references.where(F.col(at).isNotNull()).withColumn("_bucket", F.explode(F.array(bucket(at), bucket(at) - 1)))
    t, a = (F.unix_micros(F.col(c).cast("timestamp")) for c in (time, at))
    return left.join(right, [*keys, "_bucket"]).where((t <= a) & (t > a - micros)).drop("_bucket")
