"""Time-series operators over long tables (keys, month, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import pct_change


def _order(keys):
    return Window.partitionBy(*keys).orderBy("month")


def changes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percent change against the previous observed period, null on a zero base, 6 places."""
    return df.withColumn(f"{value}_change", F.round(pct_change(value, F.lag(value).over(_order(keys))), 6))


def diff(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value).over(_order(keys)))


def log_diff(df: DataFrame, keys: list[str], value: str, floor: float = 0.001) -> DataFrame:
    x = F.ln(F.greatest(F.col(value), F.lit(floor)))
    return df.withColumn("log_diff", x - F.lag(x).over(_order(keys)))


def aligned(index: DataFrame, cpi: DataFrame, keys: list[str]) -> DataFrame:
    """Index with the CPI of the same month, the changes of both and whether both are there."""
    out = index.join(cpi, [*keys, "month"], "left")
    out = changes(changes(out, keys, "combined_index"), keys, "cpi")
    return out.withColumn("both_present", F.when(F.col("combined_index").isNotNull() & F.col("cpi").isNotNull(), "yes").otherwise("no"))


def overlap_summary(index: DataFrame, cpi: DataFrame, ready: int = 24) -> DataFrame:
    """Per country: months of each series and of both, first and last common month, and whether that is enough."""
    a, b = index.select("country", "month", F.lit(1).alias("i")), cpi.select("country", "month", F.lit(1).alias("c"))
    both = a.join(b, ["country", "month"], "full_outer").withColumn("both", F.col("i").isNotNull() & F.col("c").isNotNull())
    out = both.groupBy("country").agg(
        F.count("i").alias("index_months"), F.count("c").alias("cpi_months"), F.count_if("both").alias("overlap"), F.min(F.when(F.col("both"), F.col("month"))).alias("first_month"), F.max(F.when(F.col("both"), F.col("month"))).alias("last_month")
    )
    return out.withColumn("ready", F.col("overlap") >= ready)


def spine(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every month between a key's first and last."""
    ends = df.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def interpolated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Linear interpolation onto every month between the first and the last observation."""
    grid = spine(df, keys).join(df.select(*keys, "month", value), [*keys, "month"], "left")
    back, ahead = _order(keys).rowsBetween(Window.unboundedPreceding, 0), _order(keys).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct("month", value))
    grid = grid.withColumn("p", F.last(known, ignorenulls=True).over(back)).withColumn("q", F.first(known, ignorenulls=True).over(ahead))
    whole = F.months_between("q.month", "p.month")
    part = F.months_between("month", "p.month")
    line = F.col(f"p.{value}") + (F.col(f"q.{value}") - F.col(f"p.{value}")) * F.when(whole == 0, 0.0).otherwise(part / whole)
    return grid.select(*keys, "month", line.alias(value))


def interpolate_annual(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated series where a key's months are all Januaries; the others as they are."""
    annual = df.groupBy(*keys).agg(F.bool_and(F.month("month") == 1).alias("annual"))
    tagged = df.join(annual, keys)
    rest = tagged.where("not annual").select(*keys, "month", value)
    return interpolated(tagged.where("annual"), keys, value).unionByName(rest)


def align_with_fallback(a: DataFrame, b: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, month, a, b): series a with series b interpolated to months, on common months; keys with fewer than `least` of them give common years' means instead, in January."""
    monthly = a.select(*keys, "month", F.col("a")).join(interpolated(b.select(*keys, "month", "b"), keys, "b"), [*keys, "month"])
    enough = monthly.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*keys)
    yearly = lambda df, v: df.groupBy(*keys, F.trunc("month", "YYYY").alias("month")).agg(F.avg(v).alias(v))
    years = yearly(a, "a").join(yearly(b, "b"), [*keys, "month"])
    return monthly.join(enough, keys, "left_semi").select(*keys, "month", "a", "b").unionByName(years.join(enough, keys, "left_anti").select(*keys, "month", "a", "b"))


def cpi_class(df: DataFrame, country: str, classes: dict[str, str]) -> DataFrame:
    """df with how the country's official CPI is published; null where that is not known."""
    from tallyfield.functions.columns import lookup

    return df.withColumn("cpi_class", lookup(country, classes))


def interpolate_quarterly(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, quarter like 2015-Q1 or 2015Q1, value) to months, each third of the way to the next quarter; the last stays flat."""
    year, q = F.regexp_extract("quarter", "^(\\d{4})-?Q([1-4])$", 1), F.regexp_extract("quarter", "^(\\d{4})-?Q([1-4])$", 2)
    out = df.where(q != "").withColumn("month", F.make_date(year.cast("int"), q.cast("int") * 3 - 2, F.lit(1)))
    step = (F.coalesce(F.lead(value).over(_order(keys)), F.col(value)) - F.col(value)) / 3
    out = out.withColumn("step", step).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return out.select(*keys, F.expr("cast(add_months(month, k) as date)").alias("month"), F.round(F.col(value) + F.col("step") * F.col("k"), 4).alias(value))


def expand_annual(df: DataFrame, keys: list[str], value: str, few: int = 8) -> DataFrame:
    """Series with fewer than `few` years as twelve equal months of each year."""
    years = df.withColumn("year", F.year("month")).groupBy(*keys, "year").agg(F.avg(value).alias(value))
    years = years.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("n") < few)
    years = years.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return years.select(*keys, F.make_date("year", "m", F.lit(1)).alias("month"), value)


def fill_single_gaps(df: DataFrame, keys: list[str], value: str, method: str = "midpoint") -> DataFrame:
    """df with gaps of exactly one month filled by the midpoint or the value before."""
    w = _order(keys)
    gap = df.withColumn("next", F.lead("month").over(w)).withColumn("after", F.lead(value).over(w)).where(F.months_between("next", "month") == 2)
    x = (F.col(value) + F.col("after")) / 2 if method == "midpoint" else F.col(value)
    return df.select(*keys, "month", value).unionByName(gap.select(*keys, F.add_months("month", 1).alias("month"), x.alias(value)))


def calendar_lag(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """value with that of exactly n calendar months before; months without it go."""
    before = df.select(*keys, F.add_months("month", n).alias("month"), F.col(value).alias("before"))
    return df.select(*keys, "month", value).join(before, [*keys, "month"])


def yoy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percent change against exactly twelve months before; null on a base of 0 or less."""
    out = calendar_lag(df, keys, value, 12)
    return out.withColumn("yoy", F.when(F.col("before") > 0, F.round((F.col(value) / F.col("before") - 1) * 100, 2)))


def yoy_noted(df: DataFrame, keys: list[str], value: str, note: str, fallback: str = "mean-price fallback") -> DataFrame:
    """yoy(), null where the note of either month says that the fallback stood in."""
    stood_in = F.coalesce(F.col(note), F.lit("")).contains(fallback)
    noted = df.select(*keys, "month", stood_in.alias("_now"))
    earlier = noted.select(*keys, F.add_months("month", 12).alias("month"), F.col("_now").alias("_then"))
    out = yoy(df, keys, value).join(noted, [*keys, "month"]).join(earlier, [*keys, "month"])
    return out.withColumn("yoy", F.when(~F.col("_now") & ~F.col("_then"), F.col("yoy"))).drop("_now", "_then")


def latest_valid(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The latest month with a value, else the latest month."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("month", value), F.struct(F.col(value).isNotNull(), F.col("month"))).alias("m")).select(*keys, "m.*")


def by_year(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, F.year("month").alias("year")).agg(F.avg(value).alias(value))


def frequency(df: DataFrame, keys: list[str]) -> DataFrame:
    """monthly where a key has twelve observations or more and ten or more for each year of its range, else annual."""
    years, n = F.year(F.max("month")) - F.year(F.min("month")) + 1, F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.when((n >= 12) & (n >= years * 10), "monthly").otherwise("annual").alias("frequency"))


def index_series(index: DataFrame, cpi: DataFrame, places: int = 2) -> DataFrame:
    """Months of either series with both values, rounded."""
    out = index.select("country", "month", "combined_index").join(cpi.select("country", "month", "cpi"), ["country", "month"], "full_outer")
    return out.select("country", "month", F.round("combined_index", places).alias("combined_index"), F.round("cpi", places).alias("cpi"))


def keyed_json(df: DataFrame, key: str, order: str) -> DataFrame:
    """One JSON array of points per key, in order."""
    point = F.struct(order, *[c for c in df.columns if c not in (key, order)])
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(point))).alias("points"))
