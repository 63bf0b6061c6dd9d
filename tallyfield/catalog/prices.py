"""Queries over price observations: cleaning, joins, indices, quality reports and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import classify, lookup, month_text, truncated
from tallyfield.operators import clean, index, quality, stats

from .base import QUARANTINED, Tables, query, sql

_M = "strftime(month, '%Y-%m')"
R = lambda c, n=4: F.round(c, n).alias(c)


@query("load_observations", sql("obs", "select category, count(*) as n, round(avg(price), 4) as mean_price from obs where price > 0 group by all"))
def _(t: Tables) -> DataFrame:
    items = t.read("part").select(F.col("p_name").alias("item_name"), F.col("p_type").alias("category"), F.lit("[]").alias("quality_signals"), F.lit("en").alias("language_detected"), F.lit(1.0).alias("confidence"), "p_partkey")
    items = items.withColumn("url_part", F.col("p_partkey").cast("string")).drop("item_name", "p_partkey")
    prices = t.observations.drop("category", "quality_signals").withColumn("url_part", F.element_at(F.split("url", "/"), -1))
    out = clean.load_observations(prices.withColumnRenamed("item_name", "name").withColumnRenamed("url_part", "item_name"), items.withColumnRenamed("url_part", "item_name"))
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("mean_price"))


@query("backfill_usd", sql("obs", "select country, currency, count(*) as n, round(sum(coalesce(price_usd, price / cast(case currency when 'SGD' then 1.35 else 1.0 end as double))), 2) as total from obs where coalesce(price_usd, price) > 0 group by all"))
def _(t: Tables) -> DataFrame:
    return clean.backfill_usd(t.observations, {"SGD": 1.35}).groupBy("country", "currency").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price_usd"), 2).alias("total"))


@query("backfill_usd_strict", sql("obs", "select country, count(*) as n, count(coalesce(nullif(price_usd, 0), case currency when 'SGD' then price / 1.35e0 end)) as priced from obs group by all"))
def _(t: Tables) -> DataFrame:
    return clean.backfill_usd(t.observations, {"SGD": 1.35}, None, strict=True).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count("price_usd").alias("priced"))


@query("unknown_currencies", sql("obs", "select distinct currency from obs where currency not in ('SGD', 'USD')"))
def _(t: Tables) -> DataFrame:
    return clean.unknown_currencies(t.observations, {"SGD": 1.35, "USD": 1.0})


@query("month_key", sql("obs", f"select {_M} as month, count(*) as n from obs group by all"))
def _(t: Tables) -> DataFrame:
    from tallyfield.functions.columns import month

    return t.observations.withColumn("text", F.col("collection_date").cast("string")).groupBy(month_text(month("text")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_observations", sql("cleaned", "select country, sector, source, count(*) as n, round(sum(price_usd), 2) as total from cleaned group by all"))
def _(t: Tables) -> DataFrame:
    return t.cleaned.groupBy("country", "sector", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price_usd"), 2).alias("total"))


@query("normalise_sector", sql("obs", "select case sector when 'chain' then 'formal' when 'independent' then 'informal' else sector end as sector, count(*) as n from obs where sector <> 'grocery' group by all"))
def _(t: Tables) -> DataFrame:
    return clean.normalise_sector(t.observations).groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query("exclude_sources", sql("obs", "select source, count(*) as n from obs where source <> 'src4' group by all"))
def _(t: Tables) -> DataFrame:
    return clean.exclude_sources(t.observations, ["src4"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("quarantine", sql("obs", "select country, source, count(*) as n from obs where not (country = 'NATION_3' and source = 'src1') and not (country = 'NATION_7' and source = 'src2') group by all"))
def _(t: Tables) -> DataFrame:
    return clean.quarantine(t.observations, QUARANTINED).groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"))


@query("cap_rows", sql("capped", "select obs_key, country, strftime(month, '%Y-%m') as month from capped"))
def _(t: Tables) -> DataFrame:
    return t.capped.select("obs_key", "country", month_text("month").alias("month"))


@query("drop_marked_names", "select count(*) as n from part where not regexp_matches(lower(p_name), 'widget|gizmo')")
def _(t: Tables) -> DataFrame:
    return clean.drop_marked_names(t.read("part"), "p_name", ["widget", "gizmo"]).agg(F.count(F.lit(1)).alias("n"))


@query("unreadable_names", "select c_custkey, regexp_matches(c_name, '^Customer#0+[0-9]$') or lower(trim(c_mktsegment)) in ('household') as bad from customer")
def _(t: Tables) -> DataFrame:
    df = t.read("customer")
    return df.select("c_custkey", (F.col("c_name").rlike("^Customer#0+[0-9]$") | clean.flag_unreadable("c_mktsegment", ["household"])).alias("bad"))


@query("dedupe_items", sql("obs", "select url, item_name, floor(price / 100) * 100.0 as price, currency, min(obs_key) as obs_key from obs group by url, item_name, floor(price / 100), currency"))
def _(t: Tables) -> DataFrame:
    rows = t.observations.withColumn("price", F.floor(F.col("price") / 100) * 100.0)
    return clean.dedupe_items(rows, "url", "obs_key").select("url", "item_name", "price", "currency", "obs_key")


@query("price_bounds", sql("obs", "select source, count(*) as n from obs where price > 0 and price < case source when 'src0' then 1500 when 'src1' then 3000 else 2000 end group by all"))
def _(t: Tables) -> DataFrame:
    return clean.price_bounds(t.observations, {"src0": 1500.0, "src1": 3000.0}, 2000.0).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("country_codes", sql("obs", "select country, coalesce(case country when 'NATION_1' then 'N1' when 'NATION_2' then 'N2' end, '??') as code, count(*) as n from obs group by all"))
def _(t: Tables) -> DataFrame:
    return t.observations.withColumn("code", lookup("country", {"NATION_1": "N1", "NATION_2": "N2"}, "??")).groupBy("country", "code").agg(F.count(F.lit(1)).alias("n"))


@query("truncate_text", "select doc_id, case when length(text) > 80 then rtrim(left(text, 79), ' ') || '…' else text end as short from documents")
def _(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", truncated("text", 80).alias("short"))


@query("merge_informal", sql("obs", "select country, count(*) as n from (select country from obs where source = 'src0' union all select distinct on (restaurant_name, item_name) country from obs where source = 'src1' and price_usd > 0 and country in ('NATION_1', 'NATION_2')) group by all"))
def _(t: Tables) -> DataFrame:
    o = t.observations
    base = o.where("source = 'src0'").select("item_name", "price", "price_usd", "country", "sector", F.col("collection_date").cast("string").alias("collection_date"), F.lit(None).cast("string").alias("source_image"))
    new = o.where("source = 'src1'").select(F.col("restaurant_name").alias("image_filename"), "item_name", F.col("price").alias("price_local"), "price_usd", F.col("country").alias("country_code"), F.col("collection_date").cast("string").alias("collection_date"), F.lit(1).alias("processed"))
    return clean.merge_informal(base, new, {"NATION_1": "NATION_1", "NATION_2": "NATION_2"}, "2000-01-01").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


# joins


@query("join_two_keys", sql("obs", "select country, category, count(*) as n from obs semi join (select distinct item_name, country from obs where source = 'src1' and l_linenumber = 1) x using (item_name, country) group by all"))
def _(t: Tables) -> DataFrame:
    pick = t.observations.where("source = 'src1' and l_linenumber = 1").select("item_name", "country").distinct()
    return t.observations.join(pick, ["item_name", "country"]).groupBy("country", "category").agg(F.count(F.lit(1)).alias("n"))


@query("unseen_items", sql("obs", "select item_name, arg_min(restaurant_name, obs_key) as restaurant_name, arg_min(country, obs_key) as country from obs where item_name not in (select p_name from part where p_size < 20) group by item_name"))
def _(t: Tables) -> DataFrame:
    """Items without a label yet, one restaurant and country for each; labelled are the names of small parts."""
    known = t.read("part").where("p_size < 20").select(F.col("p_name").alias("item_name"))
    return clean.unseen_representatives(t.observations, known, "item_name", ["restaurant_name", "country"], "obs_key")


_DAILY = "daily as (select restaurant_name, item_name, collection_date, avg(price) as price from obs group by all)"


def daily_prices(t: Tables) -> DataFrame:
    return t.observations.groupBy("restaurant_name", "item_name", "collection_date").agg(F.avg("price").alias("price"))


@query("asof_previous", sql("obs", f", {_DAILY} select restaurant_name, item_name, collection_date, lag(price) over w as previous_price, lag(collection_date) over w as previous_date from daily window w as (partition by restaurant_name, item_name order by collection_date)"))
def _(t: Tables) -> DataFrame:
    d = daily_prices(t)
    out = clean.asof_previous(d, d, ["restaurant_name", "item_name"], "collection_date", "price")
    return out.select("restaurant_name", "item_name", "collection_date", "previous_price", F.col("previous_collection_date").alias("previous_date"))


@query("asof_at_least", sql("obs", f", {_DAILY} select restaurant_name, item_name, max(collection_date) as collection_date, arg_max(price, collection_date) as price from daily where collection_date <= date '2000-06-30' group by restaurant_name, item_name"))
def _(t: Tables) -> DataFrame:
    return clean.asof_at_least(daily_prices(t), ["restaurant_name", "item_name"], "collection_date", F.lit("2000-06-30").cast("date")).select("restaurant_name", "item_name", "collection_date", "price")


@query("key_diff", sql("obs", "select restaurant_name, change from (select restaurant_name, 'removed' as change from (select restaurant_name from obs where month = date '1996-01-01' and source = 'src0' except select restaurant_name from obs where month = date '1996-02-01' and source = 'src0') union all select restaurant_name, 'added' from (select restaurant_name from obs where month = date '1996-02-01' and source = 'src0' except select restaurant_name from obs where month = date '1996-01-01' and source = 'src0'))"))
def _(t: Tables) -> DataFrame:
    o = t.observations.where("source = 'src0'")
    return clean.key_diff(o.where("month = date'1996-01-01'"), o.where("month = date'1996-02-01'"), ["restaurant_name"])


@query("upsert", sql("cpi", "select country, strftime(month, '%Y-%m') as month, round(case when month >= date '2000-01-01' and food is not null then food else cpi end, 4) as value from cpi"))
def _(t: Tables) -> DataFrame:
    base = t.cpi.select("country", "month", F.col("cpi").alias("value"))
    return clean.upsert(base, t.cpi.where("month >= date'2000-01-01' and food is not null").select("country", "month", F.col("food").alias("value")), ["country", "month"]).select("country", month_text("month").alias("month"), R("value"))


@query("append_new", sql("obs", "select restaurant_name, item_name, min(source) as source from (select restaurant_name, item_name, source from obs where source = 'src0' union all select restaurant_name, item_name, source from obs where source = 'src1') group by restaurant_name, item_name"))
def _(t: Tables) -> DataFrame:
    o = t.observations
    keys = ["restaurant_name", "item_name"]
    return clean.append_new(o.where("source = 'src0'").select(*keys, "source").distinct(), o.where("source = 'src1'").select(*keys, "source", "obs_key"), keys, "obs_key")


@query("prefer_source", sql("obs", ", r as (select *, dense_rank() over (partition by country, month order by case source when 'src3' then 1 else 2 end) as rk from obs where source in ('src3', 'src1')) select country, strftime(month, '%Y-%m') as month, source, count(*) as n from r where rk = 1 group by 1, 2, 3"))
def _(t: Tables) -> DataFrame:
    return clean.prefer_source(t.observations, ["country", "month"], ["src3", "src1"]).groupBy("country", month_text("month").alias("month"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("first_match", sql("obs", "select c_custkey, k.obs_key from customer left join (select country, min(obs_key) as obs_key from obs group by all) k on k.country = 'NATION_' || c_nationkey"))
def _(t: Tables) -> DataFrame:
    left = t.read("customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("country"))
    return clean.first_match(left, t.observations, "country", "obs_key").select("c_custkey", "obs_key")


# indices

PRICE_INDEX = sql("idx", f"select country, {_M} as month, round(formal_index, 4) as formal_index, round(informal_index, 4) as informal_index, round(combined_index, 4) as combined_index, item_count, 'restaurant-median index (' || restaurants || ' restaurants this month)' as coverage_note from idx")


def published(df: DataFrame) -> DataFrame:
    return df.select("country", month_text("month").alias("month"), R("formal_index"), R("informal_index"), R("combined_index"), "item_count", "coverage_note")


@query("price_index", PRICE_INDEX)
def _(t: Tables) -> DataFrame:
    return published(t.median_index)


@query("monthly_panel", sql("panel", f"select country, sector, category, restaurant_name, item_name, {_M} as month, price_usd, quality_signals from panel"))
def _(t: Tables) -> DataFrame:
    return t.panel.select("country", "sector", "category", "restaurant_name", "item_name", month_text("month").alias("month"), "price_usd", "quality_signals")


@query("price_relatives", sql("relatives", f"select country || '/' || sector as country, category, {_M} as month, round(price_relative, 4) as price_relative, item_count, adjusted_count from relatives"))
def _(t: Tables) -> DataFrame:
    return index.price_relatives(t.panel).select(F.concat_ws("/", "country", "sector").alias("country"), "category", month_text("month").alias("month"), R("price_relative"), "item_count", "adjusted_count")


@query("absence_streaks", sql("panel", f"""
, months as (select country, month, dense_rank() over (partition by country order by month) as t from (select distinct country, month from panel)),
items as (select distinct country, restaurant_name, item_name from panel), seen as (select distinct country, month, restaurant_name, item_name, 1 as seen from panel),
grid as (select i.country, m.month, m.t, m.t - coalesce(max(case when seen = 1 then t end) over (partition by i.country, i.restaurant_name, i.item_name order by m.t), 1) as absent
  from items i join months m using (country) left join seen s on s.country = i.country and s.month = m.month and s.restaurant_name = i.restaurant_name and s.item_name = i.item_name)
select country, {_M} as month, count(*) as absent_items from grid where absent > 3 group by all"""))
def _(t: Tables) -> DataFrame:
    return index.absence_streaks(t.panel).select("country", month_text("month").alias("month"), "absent_items")


_CHAIN = """
, months as (select country, month, count(*) as item_count from panel group by all),
rel as (select country, month, avg(ln(price_relative)) filter (sector = 'formal') as f, avg(ln(price_relative)) filter (sector = 'informal') as i from relatives group by all),
chained as (select m.country, m.month, item_count, exp(sum(coalesce(f, 0)) over w) * 100 as formal_index, exp(sum(coalesce(i, 0)) over w) * 100 as informal_index, row_number() over w as rn from months m left join rel r on r.country = m.country and r.month = m.month window w as (partition by m.country order by m.month)),
matched as (select country, month, formal_index, informal_index, cast({w} as double) * informal_index + (1 - cast({w} as double)) * formal_index as combined_index, item_count, case when rn = 1 then 'base period (100.0)' end as coverage_note from chained)
"""


def _weight_sql() -> str:
    from .base import _WEIGHT

    return _WEIGHT


_CHAIN = _CHAIN.replace("{w}", _weight_sql())


@query("chain_index", sql("panel relatives", _CHAIN + f"select country, {_M} as month, round(formal_index, 4) as formal_index, round(informal_index, 4) as informal_index, round(combined_index, 4) as combined_index, item_count, coverage_note from matched"))
def _(t: Tables) -> DataFrame:
    return published(index.chain_index(index.price_relatives(t.panel), t.panel, t.weights))


_STABLE = """
, smonths as (select country, month, count(*) as item_count from capped group by all),
sbase as (select country, restaurant_name, item_name, count(distinct month) as n_months, arg_min(price_usd, month || obs_key) as base from capped group by all having count(distinct month) >= 2),
scount as (select country, count(*) as n_stable from sbase group by all),
srel as (select c.country, c.month, c.sector, price_usd / base as r from capped c join sbase b using (country, restaurant_name, item_name) where base > 0),
sby as (select country, month, exp(avg(ln(r)) filter (sector = 'formal')) * 100 as f, exp(avg(ln(r)) filter (sector = 'informal')) * 100 as i from srel group by all),
stable as (select m.country, m.month, case when coalesce(n_stable, 0) >= 3 then f end as formal_index, case when coalesce(n_stable, 0) >= 3 then i end as informal_index, item_count,
  case when coalesce(n_stable, 0) < 3 then 'insufficient stable basket (' || coalesce(n_stable, 0) || ' items in ≥2 months, need 3)' when y.month is not null then 'stable-basket fallback (' || n_stable || ' items)' else 'stable-basket fallback (' || n_stable || ' items), none this month' end as coverage_note
  from smonths m left join scount c on c.country = m.country left join sby y on y.country = m.country and y.month = m.month)
"""
_BOTH = "coalesce(cast({w} as double) * informal_index + (1 - cast({w} as double)) * formal_index, formal_index, informal_index)".replace("{w}", _weight_sql())


@query("stable_basket_index", sql("capped", _STABLE + f"select country, {_M} as month, round(formal_index, 4) as formal_index, round(informal_index, 4) as informal_index, round({_BOTH}, 4) as combined_index, item_count, coverage_note from stable"))
def _(t: Tables) -> DataFrame:
    return published(index.stable_basket_index(t.capped, t.weights))


@query("index_with_fallback", sql("panel relatives", _CHAIN + _STABLE + f""", flat as (select country from matched where coverage_note is null group by country having bool_and(round(combined_index, 4) = 100)), good as (select * from matched where country not in (select country from flat))
select country, {_M} as month, round(formal_index, 4) as formal_index, round(informal_index, 4) as informal_index, round(combined_index, 4) as combined_index, item_count, coverage_note from good
union all select country, {_M}, round(formal_index, 4), round(informal_index, 4), round({_BOTH}, 4), item_count, coverage_note from stable where country not in (select country from good)"""))
def _(t: Tables) -> DataFrame:
    matched = index.chain_index(index.price_relatives(t.panel), t.panel, t.weights)
    return published(index.with_fallback(matched, index.stable_basket_index(t.capped, t.weights)))


@query("mean_price_index", sql("cleaned", f", m as (select country, sector, month, avg(price_usd) as x from cleaned group by all) select country, sector, {_M} as month, round(x / coalesce(nullif(first_value(x) over (partition by country, sector order by month), 0), 1) * 100, 4) as index from m"))
def _(t: Tables) -> DataFrame:
    return index.mean_price_index(t.cleaned, ["country", "sector"]).select("country", "sector", month_text("month").alias("month"), R("index"))


@query("category_price_index", sql("cleaned", f", m as (select country, month, avg(price_usd) as x from cleaned where category in ('ECONOMY', 'SMALL') group by all) select country, {_M} as month, round(x / coalesce(nullif(first_value(x) over (partition by country order by month), 0), 1) * 100, 4) as index from m"))
def _(t: Tables) -> DataFrame:
    return index.mean_price_index(t.cleaned, ["country"], F.col("category").isin("ECONOMY", "SMALL")).select("country", month_text("month").alias("month"), R("index"))


@query("rebased_cpi", sql("cpi", f"select country, {_M} as month, round(food / first_value(food ignore nulls) over (partition by country order by month rows between unbounded preceding and unbounded following) * 100, 4) as rebased from cpi"))
def _(t: Tables) -> DataFrame:
    return index.rebased(t.cpi, ["country"], "food").select("country", month_text("month").alias("month"), R("rebased"))


@query("stratified_index", sql("cleaned", f"""
, sm as (select country, source, restaurant_name, sector, month, median(price_usd) as m from cleaned group by all having median(price_usd) > 0),
ss as (select country, source, sector, month, exp(avg(ln(m))) as g from sm group by all), sb as (select *, g / first_value(g) over (partition by country, source, sector order by month) * 100 as x from ss),
wide as (select country, source, month, max(x) filter (sector = 'formal') as formal_index, max(x) filter (sector = 'informal') as informal_index from sb group by all)
select country, source, {_M} as month, round({_BOTH}, 4) as combined_index, count(*) over (partition by country, source) as n_months from wide
where country in (select country from cleaned group by all having count(distinct source) >= 2) qualify n_months >= 3"""))
def _(t: Tables) -> DataFrame:
    return index.stratified_index(t.cleaned, t.weights).select("country", "source", month_text("month").alias("month"), R("combined_index"), "n_months")


@query("keyed_json", sql("idx", f"select country, list(struct_pack(m := {_M}, n := item_count) order by month) as pts from idx group by all").replace("list(struct_pack(m := strftime(month, '%Y-%m'), n := item_count) order by month) as pts", "'[' || string_agg('{\"month\":\"' || strftime(month, '%Y-%m') || '\",\"item_count\":' || item_count || '}', ',' order by month) || ']' as points"))
def _(t: Tables) -> DataFrame:
    from tallyfield.operators.series import keyed_json

    return keyed_json(t.median_index.select("country", month_text("month").alias("month"), "item_count"), "country", "month")


# change detection, rollups and quality


@query("price_changes", sql("obs", f""", {_DAILY}, p as (select *, lag(price) over (partition by restaurant_name, item_name order by collection_date) as old_price from daily)
select restaurant_name, item_name, collection_date, old_price, price as new_price, round((price - old_price) / old_price * 100, 4) as price_change_pct from p where old_price > 0 and abs(price - old_price) > 1e-6"""))
def _(t: Tables) -> DataFrame:
    return quality.price_changes(daily_prices(t)).select("restaurant_name", "item_name", "collection_date", "old_price", "new_price", "price_change_pct")


_CHANGES = f"{_DAILY}, p as (select *, lag(price) over (partition by restaurant_name, item_name order by collection_date) as old_price from daily), ch as (select *, round((price - old_price) / old_price * 100, 4) as pct from p where old_price > 0 and abs(price - old_price) > 1e-6)"


@query("top_changes", sql("obs", f""", {_CHANGES}, r as (select *, row_number() over (order by pct desc, restaurant_name, item_name, collection_date) as up, row_number() over (order by pct, restaurant_name, item_name, collection_date) as down from ch)
select 'up' as direction, up as rank, restaurant_name, item_name, collection_date, pct as price_change_pct from r where up <= 5 union all select 'down', down, restaurant_name, item_name, collection_date, pct from r where down <= 5"""))
def _(t: Tables) -> DataFrame:
    return quality.top_changes(quality.price_changes(daily_prices(t)), 5).select("direction", "rank", "restaurant_name", "item_name", "collection_date", "price_change_pct")


@query("change_stats", sql("obs", f", {_CHANGES} select strftime(collection_date, '%Y-%m') as month, count(*) as n, round(avg(pct), 4) as mean_pct, max(pct) as max_pct, min(pct) as min_pct from ch group by all"))
def _(t: Tables) -> DataFrame:
    c = quality.price_changes(daily_prices(t))
    return c.groupBy(month_text("collection_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price_change_pct"), 4).alias("mean_pct"), F.max("price_change_pct").alias("max_pct"), F.min("price_change_pct").alias("min_pct"))


@query("items_collected", sql("obs", "select country, count(*) as items, count(distinct restaurant_name) as restaurants from obs where month = date '1998-03-01' group by grouping sets ((country), ())"))
def _(t: Tables) -> DataFrame:
    return quality.items_collected(t.observations, "1998-03-01")


@query("profile_counts", sql("obs", "select 'country' as kind, country as value, count(*) as n from obs group by country union all select 'sector', coalesce(sector, 'NULL'), count(*) from obs group by sector union all select 'source', coalesce(source, 'NULL'), count(*) from obs group by source union all (select 'date', cast(collection_date as varchar), count(*) from obs group by collection_date order by collection_date desc limit 10)"))
def _(t: Tables) -> DataFrame:
    return quality.profile_counts(t.observations)


@query("sample_per_key", sql("obs", "select country, obs_key from obs qualify row_number() over (partition by country order by md5(obs_key || '7'), obs_key) <= 3"))
def _(t: Tables) -> DataFrame:
    return clean.cap_rows(t.observations, ["country"], 3, "7", "obs_key").select("country", "obs_key")


@query("gap_to_target", sql("obs", "select country, count(*) as n, greatest(0, 2400 - count(*)) as gap, case when count(*) >= 2400 then 'ok' else 'short' end as status from obs group by all"))
def _(t: Tables) -> DataFrame:
    return quality.gap_to_target(t.observations, 2400)


@query("quality_report", sql("obs", """, q as (select count(*) as n, count(*) filter (price is null or price = 0) as bad_price, count(*) filter (price_usd is null) as no_usd, round(100.0 * count(price_usd) / count(*), 2) as usd_pct, count(*) filter (price_usd < 0.01 or price_usd > 10000) as out_of_range, count(*) filter (trim(item_name) = '') as unnamed from obs),
c as (select min(n) as least from (select count(*) as n from obs group by country))
select 'null_or_zero_price' as "check", cast(bad_price as double) as value, bad_price = 0 as passed from q union all select 'missing_usd', no_usd, no_usd = 0 from q union all select 'usd_coverage', usd_pct, usd_pct >= 99 from q
union all select 'out_of_range', out_of_range, out_of_range = 0 from q union all select 'empty_names', unnamed, unnamed = 0 from q union all select 'least_rows_of_a_country', least, least >= 100 from c"""))
def _(t: Tables) -> DataFrame:
    return quality.quality_report(t.observations, 100)


@query("snapshot_delta", sql("obs", "select country, count(*) filter (month < date '2000-01-01') as rows_before, count(*) as rows_after, count(*) - count(*) filter (month < date '2000-01-01') as added, count(distinct month) - count(distinct month) filter (month < date '2000-01-01') as new_months from obs group by all"))
def _(t: Tables) -> DataFrame:
    o = t.observations
    return quality.delta(quality.snapshot(o.where("month < date'2000-01-01'")), quality.snapshot(o))


@query("ingest_alarms", sql("obs", ", d as (select country, count(*) filter (month >= date '2001-11-01') as added, count(*) as n from obs group by all) select country, case when added = 0 then 'zero yield' else 'few rows' end as alarm from d where added = 0 or n < 2300"))
def _(t: Tables) -> DataFrame:
    o = t.observations
    return quality.ingest_alarms(quality.delta(quality.snapshot(o.where("month < date'2001-11-01'")), quality.snapshot(o)), 2300)


@query("row_guard", sql("obs", "select count(*) as rows, count(*) >= 50000 as enough from obs"))
def _(t: Tables) -> DataFrame:
    o = t.observations
    return quality.row_guard(quality.delta(quality.snapshot(o.where("month < date'2001-11-01'")), quality.snapshot(o)))


@query("merge_informal_currency", sql("obs", "select currency, count(*) as n from (select distinct on (restaurant_name, item_name) 'USD' as currency from obs where source = 'src1' and price_usd > 0 and country in ('NATION_1', 'NATION_2')) group by all"))
def _(t: Tables) -> DataFrame:
    o = t.observations.where("source = 'src1'")
    new = o.select(F.col("restaurant_name").alias("image_filename"), "item_name", F.col("price").alias("price_local"), "price_usd", F.col("country").alias("country_code"), F.col("collection_date").cast("string").alias("collection_date"), F.lit(1).alias("processed"))
    base = o.limit(0).select("item_name", "price", "price_usd", "country", "sector", "currency", F.col("collection_date").cast("string").alias("collection_date"), F.lit(None).cast("string").alias("source_image"))
    return clean.merge_informal(base, new, {"NATION_1": "NATION_1", "NATION_2": "NATION_2"}, "2000-01-01", "USD").groupBy("currency").agg(F.count(F.lit(1)).alias("n"))


@query("price_counts", sql("cleaned", "select country, count(*) filter (sector = 'formal') as formal_items, count(*) filter (sector = 'informal') as informal_items, count(distinct restaurant_name) filter (sector = 'formal') as formal_restaurants, count(distinct restaurant_name) filter (sector = 'informal') as informal_restaurants, round(avg(price_usd) filter (sector = 'formal'), 2) as formal_mean, round(avg(price_usd) filter (sector = 'informal'), 2) as informal_mean from cleaned group by all"))
def _(t: Tables) -> DataFrame:
    return quality.price_counts(t.cleaned)


@query("page_prices", sql("obs", "select obs_key, country, collection_date, price, (select count(*) from obs where lower(country) = 'nation_5' and sector = 'chain' and collection_date between date '1997-01-01' and date '1999-12-31') as total from obs where lower(country) = 'nation_5' and sector = 'chain' and collection_date between date '1997-01-01' and date '1999-12-31' order by collection_date desc, obs_key limit 20 offset 20"))
def _(t: Tables) -> DataFrame:
    return quality.page_prices(t.observations, country="nation_5", sector="chain", since="1997-01-01", until="1999-12-31", page=2, per_page=20).select("obs_key", "country", "collection_date", "price", "total")


@query("recent_changes", sql("obs", f", {_CHANGES} select restaurant_name, item_name, collection_date, pct as price_change_pct from ch where abs(pct) >= 50 order by collection_date desc, abs(pct) desc, restaurant_name, item_name limit 25"))
def _(t: Tables) -> DataFrame:
    return quality.recent_changes(quality.price_changes(daily_prices(t)), 50.0, 25).select("restaurant_name", "item_name", "collection_date", "price_change_pct")


@query("target_status", sql("obs", "select s_name as restaurant_name, case when exists (select 1 from obs where restaurant_name = s_name and month >= date '2001-06-01' and source = 'src0') then 'proven' else 'unproven' end as status from supplier"))
def _(t: Tables) -> DataFrame:
    return quality.target_status(t.read("supplier").select(F.col("s_name").alias("restaurant_name")), t.observations.where("month >= date'2001-06-01' and source = 'src0'"), "restaurant_name")


@query("candidate_pool", sql("obs", "select restaurant_name, count(*) as n from obs where restaurant_name not in (select restaurant_name from obs where source = 'src0' and month < date '1995-02-01') and lower(item_name) not like '%widget%' group by all order by n desc, restaurant_name limit 30"))
def _(t: Tables) -> DataFrame:
    known = t.observations.where("source = 'src0' and month < date'1995-02-01'").select("restaurant_name")
    pool = clean.drop_marked_names(t.observations, "item_name", ["widget"]).join(known, "restaurant_name", "left_anti")
    return pool.groupBy("restaurant_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "restaurant_name").limit(30)


@query("sector_ratio", sql("cleaned", ", m as (select country, median(price_usd) filter (sector = 'informal') as informal, median(price_usd) filter (sector = 'formal') as formal from cleaned group by all) select country, round(informal, 4) as informal, round(formal, 4) as formal, round(informal / formal, 4) as ratio, coalesce(informal / formal > 4 or informal / formal < 0.05, false) as flag from m"))
def _(t: Tables) -> DataFrame:
    return stats.sector_ratio(t.cleaned, "country").select("country", R("informal"), R("formal"), R("ratio"), "flag")


@query("zscore_outliers", sql("cleaned", ", z as (select obs_key, country, case when count(*) over w >= 3 and stddev_samp(price_usd) over w > 0 then (price_usd - avg(price_usd) over w) / stddev_samp(price_usd) over w end as z from cleaned window w as (partition by country, category)) select country, count(*) filter (abs(z) > 3) as outliers, round(max(z), 3) as max_z from z group by all"))
def _(t: Tables) -> DataFrame:
    return stats.zscores(t.cleaned, ["country", "category"], "price_usd").groupBy("country").agg(F.count_if("outlier").alias("outliers"), F.round(F.max("z"), 3).alias("max_z"))


@query("descriptive_stats", sql("cleaned", f"select country, count(*) as n, count(*) filter (sector = 'formal') as formal_n, count(*) filter (sector = 'informal') as informal_n, round(avg(price_usd), 4) as mean, round(stddev_samp(price_usd), 4) as sd, round(avg(price_usd) filter (sector = 'formal'), 4) as formal_mean, round(avg(price_usd) filter (sector = 'informal'), 4) as informal_mean, count(distinct item_name) as items, count(distinct restaurant_name) as restaurants, count(distinct month) as months, strftime(min(month), '%Y-%m') as first_month from cleaned group by all"))
def _(t: Tables) -> DataFrame:
    return stats.descriptive(t.cleaned, "country").select("country", "n", "formal_n", "informal_n", R("mean"), R("sd"), R("formal_mean"), R("informal_mean"), "items", "restaurants", "months", month_text("first_month").alias("first_month"))


@query("pivot_sectors", sql("cpi", f"select {_M} as month, round(max(cpi) filter (country = 'NATION_0'), 4) as overall, round(max(cpi) filter (country = 'NATION_1'), 4) as food from cpi where country in ('NATION_0', 'NATION_1') group by all"))
def _(t: Tables) -> DataFrame:
    from tallyfield.sources.tables import pivot_divisions

    rows = t.cpi.where("country in ('NATION_0', 'NATION_1')").select("month", F.when(F.col("country") == "NATION_0", "overall").otherwise("01").alias("division"), F.col("cpi").alias("value"))
    return pivot_divisions(rows).select(month_text("month").alias("month"), F.round("cpi_value", 4).alias("overall"), F.round("cpi_food", 4).alias("food"))


_RULES = [("RING", ["ring", "red"]), ("PLATE", ["plate", "late"]), ("BOLT", ["bolt", "old"])]


@query("classify_items", "select p_partkey, case when lower(p_name) like '%ring%' or lower(p_name) like '%red%' then 'RING' when lower(p_name) like '%plate%' or lower(p_name) like '%late%' then 'PLATE' when lower(p_name) like '%bolt%' or lower(p_name) like '%old%' then 'BOLT' else 'OTHER' end as category from part")
def _(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", classify("p_name", _RULES).alias("category"))


def _case() -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(n, '{k}')" for k in ks) + f" then '{c}'" for c, ks in params.CATEGORY_RULES) + " else 'OTHER' end"


@query("classify_documents", f"select category, count(*) as n from (select {_case()} as category from (select lower(text) as n from documents)) group by all")
def _(t: Tables) -> DataFrame:
    return t.read("documents").select(classify("text", params.CATEGORY_RULES).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("item_signals", "select p_partkey, concat_ws(',', case when regexp_matches(lower(p_name), 'mini|small|snack size|lite|half|reduced|less') then 'PORTION_REDUCTION' end, case when regexp_matches(lower(p_name), 'premium|special|deluxe|signature|wagyu|truffle|aged|fresh') then 'PREMIUM_UPGRADE' end, case when regexp_matches(lower(p_name), 'new recipe|improved|real|classic|original|traditional|now with') then 'INGREDIENT_CHANGE' end, case when regexp_matches(lower(p_name), 'jumbo|large|big|super|xxl|double|extra') then 'SIZE_INCREASE' end) as signals from part")
def _(t: Tables) -> DataFrame:
    from tallyfield.functions.columns import signals

    return t.read("part").select("p_partkey", F.concat_ws(",", signals("p_name", params.SIGNAL_RULES)).alias("signals"))


@query("label_accuracy", ", g as (".replace(", g as (", "with g as (") + "select lang, case when regexp_matches(text, '[%$#&*!]{2}') then 0 else 1 end as assigned, quality as manual from documents join labels using (doc_id)) select lang, count(*) as n, round(avg(case when assigned = manual then 1.0 else 0.0 end), 4) as accuracy, avg(case when assigned = manual then 1.0 else 0.0 end) < 0.85 as weak from g group by grouping sets ((lang), ())")
def _(t: Tables) -> DataFrame:
    rows = t.read("documents").join(t.read("labels"), "doc_id").select("lang", F.when(F.col("text").rlike("[%$#&*!]{2}"), 0).otherwise(1).alias("assigned"), F.col("quality").alias("manual"))
    return quality.accuracy(rows, ["lang"], "assigned", "manual")


@query("confusion", "with g as (select case when regexp_matches(text, '[%$#&*!]{2}') then 0 else 1 end as assigned, quality as manual from documents join labels using (doc_id)) select cast(manual as bigint) as manual, count(*) filter (assigned = 0) as \"0\", count(*) filter (assigned = 1) as \"1\" from g group by all")
def _(t: Tables) -> DataFrame:
    rows = t.read("documents").join(t.read("labels"), "doc_id").select(F.when(F.col("text").rlike("[%$#&*!]{2}"), 0).otherwise(1).alias("assigned"), F.col("quality").cast("long").alias("manual"))
    return rows.groupBy("manual").pivot("assigned", [0, 1]).count().fillna(0)


@query("stratified_sample", "select doc_id, lang from (select *, row_number() over (partition by lang order by md5(cast(doc_id as varchar) || 's'), doc_id) as rn from documents) where rn <= 10")
def _(t: Tables) -> DataFrame:
    return clean.cap_rows(t.read("documents"), ["lang"], 10, "s", F.col("doc_id").cast("string")).select("doc_id", "lang")




@query("turnover", sql("obs", f""", seen as (select distinct country, month, restaurant_name from obs), m as (select country, month, restaurant_name, 'added' as change from seen s where not exists (select 1 from seen b where b.country = s.country and b.restaurant_name = s.restaurant_name and b.month = s.month - interval 1 month)
union all select country, cast(month + interval 1 month as date), restaurant_name, 'removed' from seen s where not exists (select 1 from seen b where b.country = s.country and b.restaurant_name = s.restaurant_name and b.month = s.month + interval 1 month)) select country, {_M} as month, restaurant_name, change from m"""))
def _(t: Tables) -> DataFrame:
    """Restaurants that come and go, by country and month."""
    return quality.turnover(t.observations, "restaurant_name", ["country"]).select("country", month_text("month").alias("month"), "restaurant_name", "change")


@query("country_listing", sql("obs", "select country, count(*) as n_items, count(distinct restaurant_name) as n_restaurants, null::double as p from obs group by country"))
def _(t: Tables) -> DataFrame:
    """Before anything is published: counted from the prices."""
    from tallyfield.operators.serving import country_listing

    return country_listing(t.spark.createDataFrame([], "country string, n_items long, n_restaurants long, p double"), t.observations)


@query("label_histograms", sql("obs", "select 'category' as kind, category as value, count(*) as n from obs group by all union all select 'signal', s, count(*) from (select unnest(from_json(quality_signals, '[\"VARCHAR\"]')) as s from obs) group by all union all select 'language', case when item_name like '%e%' then 'en' end, count(*) from obs group by all"))
def _(t: Tables) -> DataFrame:
    from tallyfield.operators.labels import label_histograms

    return label_histograms(t.observations.withColumn("language", F.when(F.col("item_name").contains("e"), "en")), "category", "quality_signals", "language")
