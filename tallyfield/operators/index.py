"""Price indices: matched-model, stable-basket, restaurant-median and mean-price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import geomean, hedonic


def monthly_panel(df: DataFrame) -> DataFrame:
    """Median price of each item of a restaurant in a month, with the signals of its first row (smallest obs_key)."""
    keys = ["country", "sector", "category", "restaurant_name", "item_name", "month"]
    return df.groupBy(*keys).agg(F.median("price_usd").alias("price_usd"), F.min_by("quality_signals", "obs_key").alias("quality_signals"))


def _months(panel: DataFrame) -> DataFrame:
    """(country, month, t, next): the country's observed months, numbered from 1, each with the one after it; a row for each month, not for each item."""
    order = Window.partitionBy("country").orderBy("month")
    months = panel.select("country", "month").distinct()
    return months.withColumn("t", F.row_number().over(order)).withColumn("next", F.lead("month").over(order))


def price_relatives(panel: DataFrame) -> DataFrame:
    """Geomean of item price ratios against the country's previous observed month, by country, sector, category and month."""
    keys = ["country", "sector", "category", "restaurant_name", "item_name"]
    before = panel.join(_months(panel).select("country", "month", "next"), ["country", "month"]).select(*keys, F.col("next").alias("month"), F.col("price_usd").alias("before"))
    price, adjusted = hedonic("price_usd", "quality_signals")
    pairs = panel.join(before, [*keys, "month"]).withColumn("adjusted", adjusted).withColumn("ratio", price / F.col("before"))
    ok = (F.col("ratio") > 0.01) & (F.col("ratio") < 100)
    out = pairs.groupBy("country", "sector", "category", "month").agg(
        geomean(F.when(ok, F.col("ratio"))).alias("price_relative"), F.count_if(ok).alias("item_count"), F.count_if("adjusted").alias("adjusted_count")
    )
    return out.where("item_count > 0")


def absence_streaks(panel: DataFrame, most: int = 3) -> DataFrame:
    """Per country and month, items absent for more than `most` observed months in a row; counting starts at the second month.

    Each item gives the ends of its long absences, not a row for each month of them; the counts of
    absent items are the running sums of absences that begin less those that are over.
    """
    months = _months(panel).select("country", "month", "t")
    seen = panel.select("country", "restaurant_name", "item_name", "month").distinct().join(months, ["country", "month"])
    last = months.groupBy("country").agg(F.max("t").alias("last"))
    item = Window.partitionBy("country", "restaurant_name", "item_name").orderBy("t")
    seen = seen.join(last, "country").withColumn("before", F.lag("t").over(item)).withColumn("after", F.coalesce(F.lead("t").over(item), F.col("last") + 1))
    gap = lambda start, end: F.when(start < end, F.array(F.struct(start.alias("t"), F.lit(1).alias("step")), F.struct(end.alias("t"), F.lit(-1).alias("step"))))
    none = F.array().cast("array<struct<t: int, step: int>>")
    lead_in = F.when(F.col("before").isNull(), gap(F.lit(most + 2), F.col("t")))
    ends = seen.select("country", F.inline(F.concat(F.coalesce(lead_in, none), F.coalesce(gap(F.col("t") + most + 1, F.col("after")), none))))
    steps = ends.groupBy("country", "t").agg(F.sum("step").alias("step"))
    running = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("country").orderBy("t"))
    return months.join(steps, ["country", "t"], "left").withColumn("absent_items", running).where("absent_items > 0").select("country", "month", "absent_items")


def combined(weights: Column, both_needed: bool = False) -> Column:
    """Weighted informal and formal index; where one is missing the other, or null if both are needed."""
    both = weights * F.col("informal_index") + (1 - weights) * F.col("formal_index")
    return both if both_needed else F.coalesce(both, F.col("formal_index"), F.col("informal_index"))


def chain_index(relatives: DataFrame, panel: DataFrame, weights: Column) -> DataFrame:
    """Chained sector indices from base 100: every month times the geomean of its categories' relatives, 1 where there are none."""
    months = panel.groupBy("country", "month").agg(F.count(F.lit(1)).alias("item_count"))
    by = relatives.where("sector in ('formal', 'informal')").groupBy("country", "month").pivot("sector", ["formal", "informal"]).agg(F.avg(F.ln("price_relative")))
    w = Window.partitionBy("country").orderBy("month")
    out = months.join(by, ["country", "month"], "left")
    for s in ("formal", "informal"):
        out = out.withColumn(f"{s}_index", F.exp(F.sum(F.coalesce(s, F.lit(0.0))).over(w)) * 100)
    note = F.when(F.row_number().over(w) == 1, "base period (100.0)")
    return out.withColumn("combined_index", combined(weights, True)).withColumn("coverage_note", note).drop("formal", "informal")


def degenerate(index: DataFrame) -> DataFrame:
    """Countries with months after the base, all of them at 100."""
    rest = index.where("coverage_note is null")
    return rest.groupBy("country").agg(F.bool_and(F.round("combined_index", 4) == 100.0).alias("flat")).where("flat").select("country")


def stable_basket_index(df: DataFrame, weights: Column) -> DataFrame:
    """Index over items seen in several months, each relative to its earliest price; null with a note where too few."""
    item = ["country", "restaurant_name", "item_name"]
    months = df.groupBy("country", "month").agg(F.count(F.lit(1)).alias("item_count"))
    base = df.groupBy(*item).agg(F.count_distinct("month").alias("n_months"), F.min_by("price_usd", F.struct("month", "obs_key")).alias("base"))
    base = base.where(F.col("n_months") >= params.MIN_ITEM_MONTHS)
    count = base.groupBy("country").agg(F.count(F.lit(1)).alias("n_stable"))
    rel = df.join(base.where("base > 0"), item).withColumn("relative", F.col("price_usd") / F.col("base"))
    by = rel.groupBy("country", "month").pivot("sector", ["formal", "informal"]).agg((geomean("relative") * 100).alias("x"))
    seen = rel.select("country", "month").distinct().withColumn("covered", F.lit(True))
    out = months.join(count, "country", "left").join(by, ["country", "month"], "left").join(seen, ["country", "month"], "left")
    enough = F.coalesce("n_stable", F.lit(0)) >= params.MIN_STABLE_ITEMS
    for s in ("formal", "informal"):
        out = out.withColumn(f"{s}_index", F.when(enough, F.col(s)))
    note = (
        F.when(~enough, F.format_string("insufficient stable basket (%d items in ≥%d months, need %d)", F.coalesce("n_stable", F.lit(0)), F.lit(params.MIN_ITEM_MONTHS), F.lit(params.MIN_STABLE_ITEMS)))
        .when(F.col("covered"), F.format_string("stable-basket fallback (%d items)", "n_stable"))
        .otherwise(F.format_string("stable-basket fallback (%d items), none this month", "n_stable"))
    )
    return out.withColumn("combined_index", combined(weights)).withColumn("coverage_note", note).select("country", "month", "formal_index", "informal_index", "combined_index", "item_count", "coverage_note")


#: What a month's index needs of each sector; see sector_sums().
SUMS = {"sector": "string", "logs": "double", "medians": "long", "items": "long", "restaurants": "long"}


def sector_sums(df: DataFrame, by: tuple[str, ...] = ("country",)) -> DataFrame:
    """By `by`, month and sector: count and sum of the logs of the restaurants' medians, items, and restaurants (counted once, at their first sector)."""
    keys = list(by)
    medians = df.groupBy(*keys, "month", "restaurant_name", "sector").agg(F.median("price_usd").alias("m"), F.count(F.lit(1)).alias("n")).where("m > 0")
    once = F.row_number().over(Window.partitionBy(*keys, "month", "restaurant_name").orderBy("sector")) == 1
    return medians.withColumn("once", once).groupBy(*keys, "month", "sector").agg(
        F.sum(F.ln("m")).alias("logs"), F.count(F.lit(1)).alias("medians"), F.sum("n").alias("items"), F.count_if("once").alias("restaurants")
    )


def index_of_sums(sums: DataFrame, weights: Column, by: tuple[str, ...] = ("country",)) -> DataFrame:
    """The index of sector_sums(): each sector's geomean against its first month's, times 100."""
    keys = list(by)
    g = F.exp(F.col("logs") / F.col("medians"))
    sector = sums.where("sector in ('formal', 'informal')").withColumn("g", g)
    sector = sector.withColumn("x", F.col("g") / F.first("g").over(Window.partitionBy(*keys, "sector").orderBy("month")) * 100)
    wide = sector.groupBy(*keys, "month").pivot("sector", ["formal", "informal"]).agg(F.max("x"))
    months = sums.groupBy(*keys, "month").agg(F.sum("items").alias("item_count"), F.sum("restaurants").alias("restaurants"))
    out = months.join(wide, [*keys, "month"], "left").withColumnsRenamed({"formal": "formal_index", "informal": "informal_index"})
    return out.withColumn("combined_index", combined(weights)).withColumn("coverage_note", F.format_string("restaurant-median index (%d restaurants this month)", "restaurants")).drop("restaurants")


def restaurant_median_index(df: DataFrame, weights: Column, by: tuple[str, ...] = ("country",)) -> DataFrame:
    """Medians of restaurants, their geomean by sector and month, against the sector's first month, times 100."""
    return index_of_sums(sector_sums(df, by), weights, by)


def with_fallback(matched: DataFrame, stable: DataFrame) -> DataFrame:
    """The matched-model index; of countries where it is flat or missing the stable-basket one."""
    flat = degenerate(matched)
    good = matched.join(flat, "country", "left_anti")
    rest = stable.join(good.select("country").distinct(), "country", "left_anti")
    columns = ["country", "month", "formal_index", "informal_index", "combined_index", "item_count", "coverage_note"]
    return good.select(columns).unionByName(rest.select(columns))


def mean_price_index(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Mean price by month against the first month's, times 100 (a base of 0 counts as 1)."""
    rows = df if where is None else df.where(where)
    by = rows.groupBy(*keys, "month").agg(F.avg("price_usd").alias("mean"))
    base = F.first("mean").over(Window.partitionBy(*keys).orderBy("month"))
    return by.withColumn("index", F.col("mean") / F.when(base == 0, 1.0).otherwise(base) * 100).drop("mean")


def rebased(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value against its first non-null of each key, times 100."""
    base = F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("rebased", F.col(value) / base * 100)


def stratified_index(df: DataFrame, weights: Column, least_sources: int = 2, least_months: int = 3) -> DataFrame:
    """restaurant_median_index by country and source, for countries with several sources, of strata with enough months."""
    sources = df.groupBy("country").agg(F.count_distinct("source").alias("n")).where(F.col("n") >= least_sources).select("country")
    out = restaurant_median_index(df.join(sources, "country", "left_semi"), weights, ("country", "source"))
    return out.withColumn("n_months", F.count(F.lit(1)).over(Window.partitionBy("country", "source"))).where(F.col("n_months") >= least_months)
