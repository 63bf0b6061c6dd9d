"""Queries over monthly series: alignment, gaps, lead/lag statistics, forecasts and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import month_text, tier
from tallyfield.operators import series, stats

from .base import Tables, query, sql
from .prices import _M, R

K = ["country"]


def month_column():
    return month_text("month").alias("month")


@query("cpi_series", sql("cpi", f"select country, {_M} as month, round(cpi, 4) as cpi, round(food, 4) as food from cpi"))
def _(t: Tables) -> DataFrame:
    return t.cpi.select("country", month_column(), R("cpi"), R("food"))


@query("pct_change", sql("cpi", f"select country, {_M} as month, round(case when lag(cpi) over w <> 0 then (cpi - lag(cpi) over w) / lag(cpi) over w * 100 end, 6) as cpi_change from cpi window w as (partition by country order by month)"))
def _(t: Tables) -> DataFrame:
    return series.changes(t.cpi, K, "cpi").select("country", month_column(), "cpi_change")


@query("aligned_series", sql("idx cpi", f"""select i.country, strftime(i.month, '%Y-%m') as month, round(combined_index, 4) as combined_index, round(cpi, 4) as cpi,
 round(case when lag(combined_index) over w <> 0 then (combined_index - lag(combined_index) over w) / lag(combined_index) over w * 100 end, 2) as combined_index_change, round(case when lag(cpi) over w <> 0 then (cpi - lag(cpi) over w) / lag(cpi) over w * 100 end, 2) as cpi_change,
 case when combined_index is not null and cpi is not null then 'yes' else 'no' end as both_present from idx i left join cpi c on c.country = i.country and c.month = i.month window w as (partition by i.country order by i.month)"""))
def _(t: Tables) -> DataFrame:
    return series.aligned(t.median_index.select("country", "month", "combined_index"), t.cpi.select("country", "month", "cpi"), K).select("country", month_column(), R("combined_index"), R("cpi"), R("combined_index_change", 2), R("cpi_change", 2), "both_present")


@query("overlap_summary", sql("idx cpi", "select coalesce(i.country, c.country) as country, count(i.month) as index_months, count(c.month) as cpi_months, count(*) filter (i.month is not null and c.month is not null) as overlap, strftime(min(i.month) filter (c.month is not null), '%Y-%m') as first_month, strftime(max(i.month) filter (c.month is not null), '%Y-%m') as last_month, count(*) filter (i.month is not null and c.month is not null) >= 24 as ready from idx i full join cpi c on c.country = i.country and c.month = i.month group by 1"))
def _(t: Tables) -> DataFrame:
    return series.overlap_summary(t.median_index, t.cpi).select("country", "index_months", "cpi_months", "overlap", month_text("first_month").alias("first_month"), month_text("last_month").alias("last_month"), "ready")


@query("outer_series", sql("idx cpi", "select coalesce(i.country, c.country) as country, strftime(coalesce(i.month, c.month), '%Y-%m') as month, round(combined_index, 4) as combined_index, round(cpi, 4) as cpi from idx i full join cpi c on c.country = i.country and c.month = i.month"))
def _(t: Tables) -> DataFrame:
    return series.index_series(t.median_index, t.cpi, 4).select("country", month_column(), "combined_index", "cpi")


@query("inner_series", sql("idx cpi", "select i.country, strftime(i.month, '%Y-%m') as month, round(combined_index, 4) as combined_index, round(cpi, 4) as cpi from idx i join cpi c on c.country = i.country and c.month = i.month"))
def _(t: Tables) -> DataFrame:
    return t.median_index.join(t.cpi, ["country", "month"]).select("country", month_column(), R("combined_index"), R("cpi"))


_JAN = ", jan as (select country, month, cpi from cpi where extract(month from month) = 1)"
_GRID = ", ends as (select country, min(month) as a, max(month) as b from jan group by all), grid as (select country, cast(unnest(generate_series(a, b, interval 1 month)) as date) as month from ends)"


@query("interpolate_annual", sql("cpi", _JAN + _GRID + f""", p as (select g.country, g.month, a.cpi as va, b.cpi as vb, date_diff('month', a.month, g.month) as k, date_diff('month', a.month, b.month) as w from grid g join jan a on a.country = g.country and a.month = (select max(x.month) from jan x where x.country = g.country and x.month <= g.month) left join jan b on b.country = g.country and b.month = (select min(x.month) from jan x where x.country = g.country and x.month >= g.month))
select country, {_M} as month, round(case when k = 0 then va else va + (vb - va) * (k / w) end, 4) as cpi from p"""))
def _(t: Tables) -> DataFrame:
    return series.interpolate_annual(t.cpi.where(F.month("month") == 1).select("country", "month", "cpi"), K, "cpi").select("country", month_column(), R("cpi"))


@query("interpolate_quarterly", sql("cpi", f""", q as (select country, month, cpi as v from cpi where extract(month from month) in (1, 4, 7, 10)), s as (select *, (coalesce(lead(v) over (partition by country order by month), v) - v) / 3 as step from q)
select country, strftime(month + to_months(cast(k as integer)), '%Y-%m') as month, round(v + step * k, 4) as value from s, range(3) as r(k)"""))
def _(t: Tables) -> DataFrame:
    q = t.cpi.where(F.month("month").isin(1, 4, 7, 10)).select("country", F.concat(F.year("month").cast("string"), F.lit("-Q"), F.quarter("month").cast("string")).alias("quarter"), F.col("cpi").alias("value"))
    return series.interpolate_quarterly(q, K, "value").select("country", month_column(), "value")


@query("expand_annual", sql("cpi", ", y as (select country, extract(year from month) as yr, avg(cpi) as cpi from cpi group by all), f as (select *, count(*) over (partition by country) as n from y) select country, cast(yr as varchar) || '-' || lpad(cast(m as varchar), 2, '0') as month, round(cpi, 4) as cpi from f, range(1, 13) as r(m) where n < 8"))
def _(t: Tables) -> DataFrame:
    return series.expand_annual(t.cpi, K, "cpi").select("country", month_column(), R("cpi"))


_HOLED = "holed as (select country, month, cpi as v from cpi where (extract(month from month) + extract(year from month)) % 4 <> 0)"


def _holed(t: Tables) -> DataFrame:
    return t.cpi.where((F.month("month") + F.year("month")) % 4 != 0).select("country", "month", F.col("cpi").alias("v"))


for _method, _x in (("midpoint", "(v + nv) / 2"), ("ffill", "v")):

    def _fill(t: Tables, method=_method) -> DataFrame:
        return series.fill_single_gaps(_holed(t), K, "v", method).select("country", month_column(), R("v"))

    query(f"fill_gaps_{_method}", sql("cpi", f", {_HOLED}, n as (select *, lead(month) over w as nm, lead(v) over w as nv from holed window w as (partition by country order by month)) select country, {_M} as month, round(v, 4) as v from holed union all select country, strftime(month + interval 1 month, '%Y-%m'), round({_x}, 4) from n where nm = month + interval 2 month"))(_fill)


@query("calendar_lag", sql("cpi", f", {_HOLED} select a.country, strftime(a.month, '%Y-%m') as month, round(a.v, 4) as v, round(b.v, 4) as before from holed a join holed b on a.country = b.country and a.month = b.month + interval 3 month"))
def _(t: Tables) -> DataFrame:
    return series.calendar_lag(_holed(t), K, "v", 3).select("country", month_column(), R("v"), R("before"))


@query("first_difference", sql("cpi", f"select country, {_M} as month, round(cpi - lag(cpi) over w, 4) as diff, round(ln(greatest(cpi, 0.001)) - lag(ln(greatest(cpi, 0.001))) over w, 6) as log_diff from cpi window w as (partition by country order by month)"))
def _(t: Tables) -> DataFrame:
    return series.log_diff(series.diff(t.cpi, K, "cpi"), K, "cpi").select("country", month_column(), R("diff"), R("log_diff", 6))


@query("yoy", sql("cpi", "select a.country, strftime(a.month, '%Y-%m') as month, case when b.cpi > 0 then round((a.cpi / b.cpi - 1) * 100, 2) end as yoy from cpi a join cpi b on a.country = b.country and a.month = b.month + interval 12 month"))
def _(t: Tables) -> DataFrame:
    return series.yoy(t.cpi, K, "cpi").select("country", month_column(), "yoy")


@query("yoy_noted", sql("cpi", ", c as (select *, extract(month from month) = 6 as s from cpi) select a.country, strftime(a.month, '%Y-%m') as month, case when b.cpi > 0 and not a.s and not b.s then round((a.cpi / b.cpi - 1) * 100, 2) end as yoy from c a join c b on a.country = b.country and a.month = b.month + interval 12 month"))
def _(t: Tables) -> DataFrame:
    noted = t.cpi.withColumn("note", F.when(F.month("month") == 6, "mean-price fallback: few items"))
    return series.yoy_noted(noted, K, "cpi", "note").select("country", month_column(), "yoy")


@query("latest_valid", sql("cpi", ", v as (select country, month, case when extract(month from month) % 5 = 0 then food end as v from cpi) select country, strftime(month, '%Y-%m') as month, round(v, 4) as v from v qualify row_number() over (partition by country order by v is not null desc, month desc) = 1"))
def _(t: Tables) -> DataFrame:
    return series.latest_valid(t.cpi.withColumn("v", F.when(F.month("month") % 5 == 0, F.col("food"))), K, "v").select("country", month_column(), R("v"))


@query("resample_year", sql("cpi", "select country, cast(extract(year from month) as integer) as year, round(avg(cpi), 4) as cpi from cpi group by all"))
def _(t: Tables) -> DataFrame:
    return series.by_year(t.cpi, K, "cpi").select("country", "year", R("cpi"))


@query("infer_frequency", sql("cpi", ", s as (select * from cpi union all select 'annual ' || country, month, cpi, food from cpi where extract(month from month) = 1) select country, case when count(*) >= 12 and count(*) >= (extract(year from max(month)) - extract(year from min(month)) + 1) * 10 then 'monthly' else 'annual' end as frequency from s group by all"))
def _(t: Tables) -> DataFrame:
    return series.frequency(t.cpi.unionByName(t.cpi.where(F.month("month") == 1).withColumn("country", F.concat(F.lit("annual "), "country"))), K)


# lead and lag

_MOMENTS = """count(*) as n, var_pop(y) as syy, var_pop(y1) as saa, var_pop(x1) as sxx, covar_pop(y, y1) as sya, covar_pop(y, x1) as syx, covar_pop(y1, x1) as sax"""


def _f(rows: str, keys: str = "country", out: str = "f") -> str:
    return f"""select {keys}, n, case when n >= 5 and saa > 1e-12 and saa * sxx - sax * sax > 1e-12 and lo > 1e-12 then (sh - lo) / (lo / (n - 3)) end as {out} from (select *, syy - sya * sya / saa as sh, syy - (sya * sya * sxx - 2 * sya * syx * sax + syx * syx * saa) / (saa * sxx - sax * sax) as lo from (select {keys}, {_MOMENTS} from {rows} group by all))"""


@query("granger_lag1", sql("lagrows", f", g as ({_f('lagrows')}) select country, n, round(f, 4) as f from g"))
def _(t: Tables) -> DataFrame:
    return stats.f_statistic(t.lag_rows, K).select("country", "n", R("f"))


@query("granger_lag1_strict", sql("lagrows", f", sr as (select l.* from lagrows l semi join dx on dx.country = l.country and dx.month = l.month), g as ({_f('sr')}) select country, n, round(f, 4) as f from g"))
def _(t: Tables) -> DataFrame:
    change = lambda df, v: series.calendar_lag(df.where(F.col(v).isNotNull()), K, v, 1).select("country", "month", (F.col(v) - F.col("before")).alias("v"))
    return stats.granger_lag1(change(t.median_index, "combined_index"), change(t.cpi, "cpi"), K, strict=True).select("country", "n", R("f"))


@query("granger_reversed", sql("dx dy", ", rr as (select a.country, a.month, a.v as y, b.v as y1, x.v as x1 from dx a join dx b on a.country = b.country and a.month = b.month + interval 1 month join dy x on a.country = x.country and a.month = x.month + interval 1 month), g as (" + _f("rr") + ") select country, n, round(f, 4) as f from g"))
def _(t: Tables) -> DataFrame:
    change = lambda df, v: series.calendar_lag(df.where(F.col(v).isNotNull()), K, v, 1).select("country", "month", (F.col(v) - F.col("before")).alias("v"))
    return stats.granger_lag1(change(t.cpi, "cpi"), change(t.median_index, "combined_index"), K).select("country", "n", R("f"))


_POS = ", pp as (select *, row_number() over (partition by country order by month) - 1 as pos, count(*) over (partition by country) as size from lagrows)"
_SUMMARY = "select o.country, count(*) as draws, round(median(d.f), 4) as median_f, round(quantile_cont(d.f, 0.95), 4) as q95_f, round(max(d.f), 4) as max_f, round((1 + count(*) filter (d.f >= o.f * (1 - 1e-9))) / (1 + count(*)), 6) as p_value from fd d join ob o on o.country = d.country where d.f is not null and o.f is not null group by all"
_DRAWN = f", fd as ({_f('drawn', 'draw, country')}), ob as ({_f('lagrows')})"
_TAIL = _DRAWN + " " + _SUMMARY


def _null(t: Tables, drawn: DataFrame) -> DataFrame:
    null = stats.f_statistic(drawn, ["draw", "country"])
    seen = stats.f_statistic(t.lag_rows, K).where("f is not null")
    return stats.null_summary(null, seen, K).select("country", "draws", R("median_f"), R("q95_f"), R("max_f"), R("p_value", 6))


_SHUFFLE = _POS + f", dd as (select * from pp, range(1, {params.DRAWS + 1}) as r(draw)), mv as (select draw, country, x1, row_number() over (partition by draw, country order by md5(draw || '|' || country || '|' || pos || '|42')) - 1 as pos from dd), drawn as (select d.draw, d.country, d.y, d.y1, m.x1 from dd d join mv m using (draw, country, pos))"


@query("null_shuffle", sql("lagrows", _SHUFFLE + _TAIL))
def _(t: Tables) -> DataFrame:
    return _null(t, stats.shuffled(t.lag_rows, K, params.DRAWS))


@query("null_rotate", sql("lagrows", _POS + ", drawn as (select r.draw, a.country, a.y, a.y1, b.x1 from pp a join range(1, 200) as r(draw) on r.draw < a.size join pp b on b.country = a.country and b.pos = (a.pos + r.draw) % a.size)" + _TAIL))
def _(t: Tables) -> DataFrame:
    return _null(t, stats.rotated(t.lag_rows, K))


@query("null_block", sql("lagrows", _POS + f", drawn as (select r.draw, a.country, a.y, a.y1, b.x1 from pp a, range(1, {params.DRAWS + 1}) as r(draw), pp b where b.country = a.country and b.pos = (cast('0x' || substr(md5(r.draw || '|' || a.country || '|' || cast(floor(a.pos / 5.0) as bigint) || '|42'), 1, 8) as bigint) % a.size + a.pos % 5) % a.size)" + _TAIL))
def _(t: Tables) -> DataFrame:
    return _null(t, stats.blocks(t.lag_rows, K, params.DRAWS))


_LOGS = ", pt as (select a.country, ln(greatest(a.combined_index, 0.001)) - ln(greatest(b.combined_index, 0.001)) as x, ln(c.cpi) - ln(d.cpi) as y from idx a join idx b on a.country = b.country and a.month = b.month + interval 1 month join cpi c on c.country = a.country and c.month = a.month join cpi d on d.country = a.country and a.month = d.month + interval 1 month)"


@query("pass_through", sql("idx cpi", _LOGS + " select country, count(*) as n, round(regr_slope(y, x), 6) as beta, round(regr_r2(y, x), 6) as r2 from pt group by all"))
def _(t: Tables) -> DataFrame:
    log = lambda df, v: series.calendar_lag(df.where(F.col(v).isNotNull()), K, v, 1).select("country", "month", (F.ln(F.greatest(F.col(v), F.lit(0.001))) - F.ln(F.greatest(F.col("before"), F.lit(0.001)))).alias("d"))
    rows = log(t.median_index, "combined_index").withColumnRenamed("d", "x").join(log(t.cpi, "cpi").withColumnRenamed("d", "y"), ["country", "month"])
    return stats.pass_through(rows, K).select("country", "n", R("beta", 6), R("r2", 6))


def _pairs(t: Tables) -> DataFrame:
    return t.median_index.join(t.cpi, ["country", "month"]).select("country", "month", F.col("combined_index").alias("x"), F.col("cpi").alias("y"))


@query("granger_models")
def _(t: Tables) -> DataFrame:
    return stats.granger(_pairs(t), K)


@query("stationarity")
def _(t: Tables) -> DataFrame:
    return stats.stationarise(t.cpi.select("country", "month", F.col("cpi").alias("v")), K)


@query("granger_by_source")
def _(t: Tables) -> DataFrame:
    from tallyfield.operators import index

    rows = index.stratified_index(t.cleaned, t.weights).join(t.cpi, ["country", "month"]).select("country", "source", "month", F.col("combined_index").alias("x"), F.col("cpi").alias("y"))
    return stats.granger(rows, ["country", "source"])


_SPLIT = """
, pr as (select i.country, i.month, combined_index as x, cpi as y from idx i join cpi c on c.country = i.country and c.month = i.month),
sp as (select *, row_number() over (partition by country order by month desc) as back, count(*) over (partition by country) as n, y - lag(y) over w as dy, x - lag(x) over w as dx from pr window w as (partition by country order by month)),
past as (select country, avg(dy) as drift, arg_max(y, month) as last, regr_slope(dy, dx) as b, regr_intercept(dy, dx) as a from sp where back > 2 and n >= 5 group by all),
fc as (select s.country, s.month, s.y, last, last + coalesce(drift, 0) * (3 - back) as d, last + sum(a + b * dx) over (partition by s.country order by s.month) as o from sp s join past p on p.country = s.country where back <= 2 and n >= 5)
"""


@query("forecasts", sql("idx cpi", _SPLIT + f"select country, {_M} as month, round(y, 4) as y, round(d, 4) as drift_forecast, round(o, 4) as ols_forecast, round(coalesce((d + o) / 2, d), 4) as mean_forecast from fc"))
def _(t: Tables) -> DataFrame:
    return stats.forecasts(_pairs(t), K).select("country", month_column(), R("y"), R("drift_forecast"), R("ols_forecast"), R("mean_forecast"))


@query("directional_accuracy", sql("idx cpi", _SPLIT + ", sg as (select country, sign(y - coalesce(lag(y) over w, last)) as s, sign(d - coalesce(lag(d) over w, last)) as sd, sign(coalesce((d + o) / 2, d) - coalesce(lag(coalesce((d + o) / 2, d)) over w, last)) as sm from fc window w as (partition by country order by month)) select country, avg(case when s = sd then 1.0 else 0.0 end) as drift_accuracy, avg(case when s = sm then 1.0 else 0.0 end) as mean_accuracy, avg(case when s = sm then 1.0 else 0.0 end) > avg(case when s = sd then 1.0 else 0.0 end) as adds_value from sg group by all"))
def _(t: Tables) -> DataFrame:
    return stats.directional_accuracy(stats.forecasts(_pairs(t), K), K, ["drift_forecast", "mean_forecast"])


#: Country, F and its p value by the shuffle null.
_P = _SHUFFLE + _DRAWN + ", pv as (select o.country, o.f, (1 + count(*) filter (d.f >= o.f * (1 - 1e-9))) / (1 + count(*)) as p from fd d join ob o on o.country = d.country where d.f is not null and o.f is not null group by all)"


def _p(t: Tables) -> DataFrame:
    seen = stats.f_statistic(t.lag_rows, K).where("f is not null")
    null = stats.null_summary(stats.f_statistic(stats.shuffled(t.lag_rows, K, params.DRAWS), ["draw", "country"]), seen, K)
    return seen.join(null.select("country", F.col("p_value").alias("p")), "country")


@query("jackknife", sql("lagrows", _P + " select a.country as dropped, (select count(*) from pv) - 1 as rest, (select count(*) from pv b where b.country <> a.country and b.p < 0.10) as significant, (select count(*) from pv) = 1 or (select count(*) from pv b where b.country <> a.country and b.p < 0.10) / ((select count(*) from pv) - 1) >= 0.6 as stable from pv a"))
def _(t: Tables) -> DataFrame:
    return stats.jackknife(_p(t), "country", "p")


@query("jackknife_verdict", sql("lagrows", _P + ", jk as (select a.country, (select count(*) from pv) = 1 or (select count(*) from pv b where b.country <> a.country and b.p < 0.10) / ((select count(*) from pv) - 1) >= 0.6 as stable from pv a) select count(*) as dropped, count(*) filter (stable) as stable, case when count(*) > 1 then count(*) = count(*) filter (stable) end as finding_survives from jk"))
def _(t: Tables) -> DataFrame:
    return stats.jackknife_verdict(stats.jackknife(_p(t), "country", "p"))


@query("significance_tier", sql("lagrows", _P + " select country, case when p < 0.05 then 'p<0.05' when p < 0.10 then 'p<0.10' else 'n.s.' end as tier from pv"))
def _(t: Tables) -> DataFrame:
    return _p(t).select("country", tier("p").alias("tier"))


@query("respecified", sql("lagrows", _P + " select country, round(coalesce(case when country in ('NATION_1', 'NATION_2') then 0.01 end, p), 4) as p from pv"))
def _(t: Tables) -> DataFrame:
    other = t.read("nation").where("n_nationkey in (1, 2)").select(F.col("n_name").alias("country"), F.lit(0.01).alias("p"))
    return stats.respecified(_p(t).select("country", "p"), other, "country", ["p"])


@query("crossovers", sql("lagrows", _P + ", af as (select country, case when country like '%1' then 0.2 when country like '%2' then 0.01 else p end as p from pv) select a.country, a.p as was, b.p as now, case when b.p < 0.05 then 'gained' else 'lost' end as change from pv a join af b on b.country = a.country where (a.p < 0.05) <> (b.p < 0.05)"))
def _(t: Tables) -> DataFrame:
    p = _p(t).select("country", "p")
    after = p.withColumn("p", F.when(F.col("country").endswith("1"), 0.2).when(F.col("country").endswith("2"), 0.01).otherwise(F.col("p")))
    return stats.crossovers(p, after, "country")


@query("weight_sensitivity", sql("idx", f"select country, {_M} as month, w as weight, round(w * coalesce(informal_index, 100) + (1 - w) * coalesce(formal_index, 100), 4) as combined_index from idx, (values (0.4e0), (0.5e0), (0.6e0)) as v(w)"))
def _(t: Tables) -> DataFrame:
    return stats.weight_sensitivity(t.median_index, [0.4, 0.5, 0.6]).select("country", month_column(), "weight", R("combined_index"))


@query("exclusion_contrast", sql("cleaned", """, tg as (select 'all' as spec, * from cleaned union all select 'without src0', * from cleaned where source <> 'src0'), m as (select spec, country, month, avg(price_usd) as x from tg group by all),
 i as (select spec, country, month, x / first_value(x) over (partition by spec, country order by month) * 100 as v from m) select spec, country, count(*) as months, round(avg(v), 4) as mean_index from i group by all"""))
def _(t: Tables) -> DataFrame:
    from tallyfield.operators import index

    both = t.cleaned.withColumn("spec", F.lit("all")).unionByName(t.cleaned.where("source <> 'src0'").withColumn("spec", F.lit("without src0")))
    return index.mean_price_index(both, ["spec", "country"]).groupBy("spec", "country").agg(F.count(F.lit(1)).alias("months"), F.round(F.avg("index"), 4).alias("mean_index"))


@query("basket_sensitivity", sql("cleaned", """, sp as (select 'full' as spec, * from cleaned union all select 'minus', * from cleaned where category not in ('ECONOMY', 'PROMO') union all select 'staples', * from cleaned where category in ('SMALL', 'LARGE')), m as (select spec, country, month, avg(price_usd) as x from sp group by all),
 i as (select spec, country, month, x / first_value(x) over (partition by spec, country order by month) * 100 as v from m), s as (select country, month, max(v) - min(v) as spread, count(*) as specs from i group by all) select country, round(avg(spread), 4) as mean_spread, max(specs) as specs from s group by all"""))
def _(t: Tables) -> DataFrame:
    from tallyfield.operators import index

    c = t.cleaned
    specs = c.withColumn("spec", F.explode(F.array_compact(F.array(F.lit("full"), F.when(~F.col("category").isin("ECONOMY", "PROMO"), "minus"), F.when(F.col("category").isin("SMALL", "LARGE"), "staples")))))
    i = index.mean_price_index(specs, ["spec", "country"]).groupBy("country", "month").agg((F.max("index") - F.min("index")).alias("spread"), F.count(F.lit(1)).alias("specs"))
    return i.groupBy("country").agg(F.round(F.avg("spread"), 4).alias("mean_spread"), F.max("specs").alias("specs"))


@query("results_table", sql("lagrows cpi", _P + " select n.n_name as country, round(f, 4) as f, p, m.months from nation n left join pv on pv.country = n.n_name left join (select country, count(*) as months from cpi group by all) m on m.country = n.n_name"))
def _(t: Tables) -> DataFrame:
    months = t.cpi.groupBy("country").agg(F.count(F.lit(1)).alias("months"))
    return t.read("nation").select(F.col("n_name").alias("country")).join(_p(t), "country", "left").join(months, "country", "left").select("country", R("f"), "p", "months")


@query("summarise_results", sql("lagrows", _P + " select count(*) as n, count(*) filter (p < 0.10) as significant, min(p) as best_p, round(max(f), 4) as max_f from pv"))
def _(t: Tables) -> DataFrame:
    return _p(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") < 0.10).alias("significant"), F.min("p").alias("best_p"), F.round(F.max("f"), 4).alias("max_f"))
