"""Change detection, rollups, data-quality reports and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def rows_of():
    """Number of rows, as an aggregate."""
    return F.count(F.lit(1))


def price_changes(daily: DataFrame) -> DataFrame:
    """Days whose price differs from the latest earlier one of the same (restaurant, item), with the percent."""
    w = Window.partitionBy("restaurant_name", "item_name").orderBy("collection_date")
    out = daily.withColumn("old_price", F.lag("price").over(w)).withColumnRenamed("price", "new_price")
    out = out.where((F.col("old_price") > 0) & (F.abs(F.col("new_price") - F.col("old_price")) > 1e-6))
    return out.withColumn("price_change_pct", F.round((F.col("new_price") - F.col("old_price")) / F.col("old_price") * 100, 4))


def top_changes(changes: DataFrame, k: int) -> DataFrame:
    """The k largest rises and falls; each is a bounded sort."""
    tie = ["restaurant_name", "item_name", "collection_date"]

    def side(direction, order):
        best = changes.orderBy(order, *tie).limit(k)
        return best.withColumn("direction", F.lit(direction)).withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy(order, *tie)).cast("long"))

    return side("up", F.desc("price_change_pct")).unionByName(side("down", F.asc("price_change_pct")))


def items_collected(df: DataFrame, month: str) -> DataFrame:
    """Items and distinct restaurants of a month by country, and over all (country null)."""
    rows = df.where(F.col("month") == F.lit(month).cast("date"))
    return rows.rollup("country").agg(rows_of().alias("items"), F.count_distinct("restaurant_name").alias("restaurants"))


def profile_counts(df: DataFrame, dates: int = 10) -> DataFrame:
    """Rows by country, sector and source (null as NULL), and of the latest dates."""
    by = lambda c: df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias("value")).agg(rows_of().alias("n")).select(F.lit(c).alias("kind"), "value", "n")
    latest = by("collection_date").orderBy(F.desc("value")).limit(dates).withColumn("kind", F.lit("date"))
    return by("country").unionByName(by("sector")).unionByName(by("source")).unionByName(latest)


def gap_to_target(df: DataFrame, target: int) -> DataFrame:
    out = df.groupBy("country").agg(rows_of().alias("n"))
    return out.withColumn("gap", F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col("n"))).withColumn("status", F.when(F.col("n") >= target, "ok").otherwise("short"))


def quality_report(df: DataFrame, least: int) -> DataFrame:
    """One row per check, from one pass over the rows and one over the countries' counts."""
    usd = F.col("price_usd")
    q = df.agg(
        F.count_if(F.col("price").isNull() | (F.col("price") == 0)).cast("double").alias("null_or_zero_price"), F.count_if(usd.isNull()).cast("double").alias("missing_usd"), F.round(100.0 * F.count(usd) / rows_of(), 2).alias("usd_coverage"),
        F.count_if((usd < 0.01) | (usd > 10000)).cast("double").alias("out_of_range"), F.count_if(F.trim("item_name") == "").cast("double").alias("empty_names"),
    )
    q = q.unpivot([], ["null_or_zero_price", "missing_usd", "usd_coverage", "out_of_range", "empty_names"], "check", "value")
    q = q.withColumn("passed", F.when(F.col("check") == "usd_coverage", F.col("value") >= 99).otherwise(F.col("value") == 0))
    c = df.groupBy("country").agg(rows_of().alias("n")).agg(F.min("n").cast("double").alias("value")).select(F.lit("least_rows_of_a_country").alias("check"), "value", (F.col("value") >= least).alias("passed"))
    return q.unionByName(c)


def verdict(report: DataFrame, share: float = 0.85) -> DataFrame:
    return report.agg(F.count_if("passed").alias("passed"), rows_of().alias("checks")).withColumn("ready", F.col("passed") / F.col("checks") >= share)


def snapshot(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(rows_of().alias("n"), F.count_distinct("month").alias("months"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after by country, with what came."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = before.select("country", F.col("n").alias("b"), F.col("months").alias("bm")).join(after.select("country", F.col("n").alias("a"), F.col("months").alias("am")), "country", "full_outer")
    return out.select("country", zero(F.col("b")).alias("rows_before"), zero(F.col("a")).alias("rows_after"), (zero(F.col("a")) - zero(F.col("b"))).alias("added"), (zero(F.col("am")) - zero(F.col("bm"))).alias("new_months"))


def ingest_alarms(change: DataFrame, least: int) -> DataFrame:
    """Countries without new rows, or with fewer than `least` in all."""
    alarm = F.when(F.col("added") == 0, "zero yield").when(F.col("rows_after") < least, "few rows")
    return change.select("country", alarm.alias("alarm")).where("alarm is not null")


def row_guard(change: DataFrame, least: int = 50_000) -> DataFrame:
    """One row: all rows after an ingest, and whether there are at least so many."""
    return change.agg(F.coalesce(F.sum("rows_after"), F.lit(0)).alias("rows")).withColumn("enough", F.col("rows") >= least)


def failure_alert(runs: DataFrame, key: str, failed: str, share: float = 0.5) -> DataFrame:
    """Failure rate of each key and whether it reaches the share."""
    rate = F.count_if(F.col(failed)) / rows_of()
    return runs.groupBy(key).agg(rows_of().alias("runs"), F.round(rate, 4).alias("failure_rate"), (rate >= share).alias("alert"))


def price_counts(df: DataFrame) -> DataFrame:
    """By country and, side by side, sector: items, restaurants and mean price."""
    cell = lambda s: F.col("sector") == s
    agg = []
    for s in ("formal", "informal"):
        agg += [F.count_if(cell(s)).alias(f"{s}_items"), F.count_distinct(F.when(cell(s), F.col("restaurant_name"))).alias(f"{s}_restaurants"), F.round(F.avg(F.when(cell(s), F.col("price_usd"))), 2).alias(f"{s}_mean")]
    return df.groupBy("country").agg(*agg)


def page_prices(df: DataFrame, country=None, sector=None, since=None, until=None, page: int = 1, per_page: int = 100) -> DataFrame:
    """A page of filtered prices, latest first, with the total number of matches."""
    page, per_page = max(1, page), max(1, min(1000, per_page))
    if country:
        df = df.where(F.lower("country") == country.lower())
    if sector:
        df = df.where(F.col("sector") == sector)
    if since:
        df = df.where(F.col("collection_date") >= F.lit(since).cast("date"))
    if until:
        df = df.where(F.col("collection_date") <= F.lit(until).cast("date"))
    total = df.agg(rows_of().alias("total"))
    return df.orderBy(F.desc("collection_date"), "obs_key").offset((page - 1) * per_page).limit(per_page).join(F.broadcast(total))


def recent_changes(changes: DataFrame, least_pct: float, limit: int) -> DataFrame:
    size = F.abs("price_change_pct")
    return changes.where(size >= least_pct).orderBy(F.desc("collection_date"), size.desc(), "restaurant_name", "item_name").limit(limit)


def target_status(targets: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Targets as proven (they have rows) or unproven."""
    found = seen.select(key).distinct().withColumn("_s", F.lit("proven"))
    return targets.join(found, key, "left").select(key, F.coalesce("_s", F.lit("unproven")).alias("status"))


def accuracy(df: DataFrame, by: list[str], assigned: str, manual: str, weak: float = 0.85) -> DataFrame:
    """Share of equal labels by each key and over all (key null), weak under the bound."""
    right = F.avg((F.col(assigned) == F.col(manual)).cast("double"))
    return df.rollup(*by).agg(rows_of().alias("n"), F.round(right, 4).alias("accuracy"), (right < weak).alias("weak"))


def turnover(df: DataFrame, item: str, keys: list[str] | None = None) -> DataFrame:
    """(keys..., month, item, change): what is "added" in a month, being absent the calendar month before, and "removed", being there in the month before and absent now.

    Months are those of df(keys..., month, item) and, for what is removed, the one after the last:
    every month is compared with the one before it, by one pass over the distinct (item, month).
    """
    keys = keys or []
    seen = df.where(F.col(item).isNotNull() & F.col("month").isNotNull()).select(*keys, "month", item).distinct()
    order = Window.partitionBy(*keys, item).orderBy("month")
    rows = seen.withColumns({"before": F.lag("month").over(order), "after": F.lead("month").over(order)})
    next_ = F.add_months("month", 1)
    new = F.when(F.col("before").isNull() | (F.add_months("before", 1) < F.col("month")), F.struct(F.col("month").alias("month"), F.lit("added").alias("change")))
    gone = F.when(F.col("after").isNull() | (F.col("after") > next_), F.struct(next_.alias("month"), F.lit("removed").alias("change")))
    return rows.select(*keys, item, F.explode(F.array_compact(F.array(new, gone))).alias("x")).select(*keys, "x.month", item, "x.change")
