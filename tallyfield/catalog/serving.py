"""Queries of the dashboard tables, further labels and the statistical variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import month_text
from tallyfield.operators import index, labels, quality, series, serving, stats

from .base import Tables, query, sql
from .prices import _M, R
from .series import _P, K, _p

_COUNTS = "pc as (select country, count(*) filter (sector = 'formal') as formal_items, count(*) filter (sector = 'informal') as informal_items, count(distinct restaurant_name) filter (sector = 'formal') as formal_restaurants, count(distinct restaurant_name) filter (sector = 'informal') as informal_restaurants, round(avg(price_usd) filter (sector = 'formal'), 2) as formal_mean, round(avg(price_usd) filter (sector = 'informal'), 2) as informal_mean from cleaned group by all)"
_SUMMARY = _P + f""", {_COUNTS}, ix as (select country, count(*) as months_of_data, min(month) as base_month, arg_max(combined_index, month) filter (combined_index is not null) as latest_index from idx group by all), lc as (select country, arg_max(cpi, month) as latest_cpi from cpi group by all),
 su as (select coalesce(ix.country, pv.country, pc.country) as country, coalesce(months_of_data, 0) as months_of_data, base_month, latest_index, f, p, p < 0.10 as significant, coalesce(formal_items, 0) as formal_items, coalesce(informal_items, 0) as informal_items, coalesce(formal_restaurants, 0) as formal_restaurants, coalesce(informal_restaurants, 0) as informal_restaurants, formal_mean, informal_mean, case when pv.country is null then 'no_granger_data' else 'ok' end as status
 from ix full join pv on pv.country = ix.country full join pc on pc.country = coalesce(ix.country, pv.country))"""


def _summary(t: Tables) -> DataFrame:
    results = _p(t).select("country", "f", "p", (F.col("p") < 0.10).alias("significant"), F.lit("ok").alias("status"))
    return serving.country_summary(results, t.median_index, t.cpi, quality.price_counts(t.cleaned))


@query("country_summary", sql("idx lagrows cpi cleaned", _SUMMARY + " select su.country, months_of_data, strftime(base_month, '%Y-%m') as base_month, round(latest_index, 2) as latest_index, round(latest_cpi, 2) as latest_cpi, round(f, 4) as f, p, case when significant then 'yes' when not significant then 'no' end as significant, formal_items, informal_items, formal_restaurants, informal_restaurants, formal_mean, informal_mean, status from su left join lc on lc.country = su.country"))
def _(t: Tables) -> DataFrame:
    names = ["formal_items", "informal_items", "formal_restaurants", "informal_restaurants", "formal_mean", "informal_mean", "status"]
    said = F.when(F.col("significant"), "yes").when(~F.col("significant"), "no").alias("significant")
    return _summary(t).select("country", "months_of_data", month_text("base_month").alias("base_month"), R("latest_index", 2), R("latest_cpi", 2), R("f"), "p", said, *names)


@query("totals", sql("idx lagrows cpi cleaned", _SUMMARY + " select cast(sum(formal_items + informal_items) as bigint) as items, cast(sum(months_of_data) as bigint) as months, count(*) filter (significant) as significant from su"))
def _(t: Tables) -> DataFrame:
    return serving.totals(_summary(t))


@query("latest_values", sql("idx cpi cleaned", f""", {_COUNTS}, nt as (select *, item_count < 12 as stood_in from idx), lt as (select * from nt qualify row_number() over (partition by country order by combined_index is not null desc, month desc) = 1), lc as (select country, arg_max(cpi, month) as cpi from cpi group by all)
select lt.country, {_M.replace('month', 'lt.month')} as month, round(lt.combined_index, 2) as combined_index, round(lt.formal_index, 2) as formal_index, round(lt.informal_index, 2) as informal_index, round(lc.cpi, 2) as cpi, case when not lt.stood_in and not b.stood_in and b.combined_index > 0 then round((lt.combined_index / b.combined_index - 1) * 100, 2) end as yoy_change_pct, coalesce(formal_items, 0) as formal_items, coalesce(informal_items, 0) as informal_items
from lt left join nt b on b.country = lt.country and b.month = lt.month - interval 12 month left join lc on lc.country = lt.country left join pc on pc.country = lt.country"""))
def _(t: Tables) -> DataFrame:
    noted = t.median_index.withColumn("coverage_note", F.when(F.col("item_count") < 12, "mean-price fallback: few items"))
    out = serving.latest_values(noted, t.cpi, quality.price_counts(t.cleaned))
    return out.withColumn("month", month_text("month")).withColumns({c: F.round(c, 2) for c in ("combined_index", "formal_index", "informal_index", "cpi")})


@query("index_lookup", sql("idx", f"select country, {_M} as month, round(combined_index, 4) as combined_index from idx where lower(country) = 'nation_7'"))
def _(t: Tables) -> DataFrame:
    return serving.index_lookup(t.median_index, " Nation_7").select("country", month_text("month").alias("month"), R("combined_index"))


@query("targets_today", sql("obs", "select s_name as restaurant_name, case when count(restaurant_name) > 0 then 'proven' else 'unproven' end as status, count(*) filter (collection_date = date '1997-03-03') as rows_today, count(distinct restaurant_name) filter (collection_date = date '1997-03-03') as restaurants_today from supplier left join obs on restaurant_name = s_name group by all"))
def _(t: Tables) -> DataFrame:
    targets = t.read("supplier").select(F.col("s_name").alias("restaurant_name"))
    prices = t.observations.withColumn("target", F.col("restaurant_name"))
    return serving.targets_today(targets.withColumnRenamed("restaurant_name", "target"), prices, "target", F.lit("1997-03-03").cast("date")).withColumnRenamed("target", "restaurant_name")


@query("align_with_fallback", sql("idx cpi", """, b as (select country, month, cpi as b from cpi where extract(month from month) = 1 and not (country = 'NATION_4' and extract(year from month) > 1993)), a as (select country, month, combined_index as a from idx where combined_index is not null),
 nx as (select country, month, b, lead(month) over w as m2, lead(b) over w as b2 from b window w as (partition by country order by month)),
 mo as (select a.country, a.month, a.a, case when a.month = nx.month then nx.b else nx.b + (nx.b2 - nx.b) * (date_diff('month', nx.month, a.month) / cast(date_diff('month', nx.month, nx.m2) as double)) end as b from a join nx on a.country = nx.country and (a.month = nx.month or a.month > nx.month and a.month < nx.m2)),
 en as (select country from mo group by country having count(*) >= 2),
 ye as (select x.country, x.month, x.a, y.b from (select country, cast(date_trunc('year', month) as date) as month, avg(a) as a from a group by all) x join (select country, cast(date_trunc('year', month) as date) as month, avg(b) as b from b group by all) y using (country, month))
 select country, strftime(month, '%Y-%m') as month, round(a, 4) as a, round(b, 4) as b from mo where country in (select country from en) union all select country, strftime(month, '%Y-%m'), round(a, 4), round(b, 4) from ye where country not in (select country from en)"""))
def _(t: Tables) -> DataFrame:
    b = t.cpi.where("month(month) = 1 and not (country = 'NATION_4' and year(month) > 1993)").select("country", "month", F.col("cpi").alias("b"))
    a = t.median_index.where("combined_index is not null").select("country", "month", F.col("combined_index").alias("a"))
    return series.align_with_fallback(a, b, K).select("country", month_text("month").alias("month"), R("a"), R("b"))


_CLASSES = {f"NATION_{i}": c for i, c in enumerate(params.CPI_CLASS.values())}


@query("cpi_class", sql("cpi", "select country, " + "case country " + " ".join(f"when '{k}' then '{v}'" for k, v in _CLASSES.items()) + " end as cpi_class, count(*) as months from cpi group by country"))
def _(t: Tables) -> DataFrame:
    return series.cpi_class(t.cpi, "country", _CLASSES).groupBy("country", "cpi_class").agg(F.count(F.lit(1)).alias("months"))


def _pairs(t: Tables) -> DataFrame:
    return t.median_index.join(t.cpi, ["country", "month"]).select("country", "month", F.col("combined_index").alias("x"), F.col("cpi").alias("y"))


# what needs matrices is held against numpy in the tests


@query("pass_through_models")
def _(t: Tables) -> DataFrame:
    return stats.pass_through_models(_pairs(t), K)


@query("granger_robust")
def _(t: Tables) -> DataFrame:
    return stats.granger_robust(_pairs(t), K)


@query("sector_split")
def _(t: Tables) -> DataFrame:
    by = index.mean_price_index(t.cleaned, ["country", "sector"]).join(t.cpi, ["country", "month"])
    rows = by.select("country", "sector", "month", F.col("index").alias("x"), F.col("cpi").alias("y"))
    return stats.sector_split(stats.granger_robust(rows, ["country", "sector"]))


# labels


def _case(rules, extra=lambda label: "") -> str:
    quote = lambda k: k.replace("'", "''")
    return "case " + " ".join(f"when ({' or '.join(f"contains(low, '{quote(k)}')" for k in ks)}){extra(c)} then '{c}'" for c, ks in rules) + " else 'OTHER' end"


_NAMES = "with nm as (select doc_id, lower(text) as low from documents)"
_HELD = {"BEVERAGE": " and not (contains(low, 'tea') and (contains(low, 'cake') or contains(low, 'leaf')))", "RICE_DISH": " and not contains(low, 'noodle')"}


@query("guessed_category", f"{_NAMES} select doc_id, {_case(params.GUESS_RULES)} as category from nm")
def _(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", labels.guessed_category("text").alias("category"))


@query("reference_label", f"{_NAMES} select doc_id, {_case(params.LABEL_RULES, lambda c: _HELD.get(c, ''))} as label from nm")
def _(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", labels.reference_label("text").alias("label"))





@query("parse_label_response", """select p_partkey // 10 as batch_id, cast(row_number() over (partition by p_partkey // 10 order by p_partkey) - 1 as integer) as place, p_name as item, case when p_partkey % 5 = 0 or p_partkey % 4 = 0 then 'OTHER' else 'FAST_FOOD' end as category,
 case when p_partkey % 5 = 0 then '' else 'SIZE_INCREASE' end as signals, 'en' as language_detected, cast(case when p_partkey % 5 = 0 then 0.5 when p_partkey % 3 = 0 then 1.0 when p_partkey % 3 = 1 then 0.5 else 0.25 end as double) as confidence from (select p_partkey, p_name || ' ' || p_partkey as p_name from part)""")
def _(t: Tables) -> DataFrame:
    """Parts in batches of ten; replies come fenced, in another order, and leave every fifth part out."""
    part = t.read("part").withColumn("p_name", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
    confidence = F.when(F.col("p_partkey") % 3 == 0, F.lit("1.7")).when(F.col("p_partkey") % 3 == 1, F.lit("high")).otherwise(F.lit("0.25"))
    entry = F.struct(F.col("p_name").alias("item"), F.when(F.col("p_partkey") % 4 == 0, "NO_SUCH").otherwise("FAST_FOOD").alias("category"), F.array(F.lit("SIZE_INCREASE"), F.lit("odd")).alias("quality_signals"), confidence.alias("confidence"))
    by = part.groupBy(F.floor(F.col("p_partkey") / 10).alias("batch_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("items"), F.sort_array(F.collect_list(F.when(F.col("p_partkey") % 5 != 0, entry)), asc=False).alias("e"))
    replies = by.select("batch_id", "items", F.concat(F.lit("```json\n"), F.to_json("e"), F.lit("\n```")).alias("reply"))
    out = labels.parse_label_response(replies)
    return out.select("batch_id", "place", "item", "category", F.array_join("quality_signals", ",").alias("signals"), "language_detected", "confidence")


@query("topped_up_sample", "with c as (select greatest(1, 50 // count(distinct lang)) as each from documents), r as (select doc_id, lang, md5(cast(doc_id as varchar) || 's') as mark, row_number() over (partition by lang order by md5(cast(doc_id as varchar) || 's'), doc_id) as k from documents) select doc_id, lang from r, c order by k > each, mark, doc_id limit 50")
def _(t: Tables) -> DataFrame:
    return labels.stratified_sample(t.read("documents"), "lang", 50, "s", "doc_id").select("doc_id", "lang")


@query("validation_summary", sql("cleaned", """, z as (select country, sector, count(*) over w as n, stddev_samp(price_usd) over w as s, avg(price_usd) over w as m, price_usd from cleaned window w as (partition by country, category)),
 v as (select country as country_code, sector as confidence, case when n < 3 or s is null or s = 0 then 'insufficient_data' when abs((price_usd - m) / s) > 2 then 'yes' else 'no' end as outlier from z)
 select 'items' as kind, 'total' as value, count(*) as n from v union all select 'items', 'outliers', count(*) from v where outlier = 'yes' union all select 'items', 'insufficient', count(*) from v where outlier = 'insufficient_data' union all select 'items', 'clean', count(*) from v where outlier = 'no' union all select 'confidence', coalesce(confidence, 'unknown'), count(*) from v group by confidence union all select 'country', coalesce(country_code, '?'), count(*) from v group by country_code"""))
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("country", "category")
    s, n = F.stddev_samp("price_usd").over(w), F.count(F.lit(1)).over(w)
    outlier = F.when((n < 3) | s.isNull() | (s == 0), "insufficient_data").when(F.abs((F.col("price_usd") - F.avg("price_usd").over(w)) / s) > 2, "yes").otherwise("no")
    rows = t.cleaned.select(F.col("country").alias("country_code"), F.col("sector").alias("confidence"), outlier.alias("outlier"))
    return labels.validation_summary(rows)
