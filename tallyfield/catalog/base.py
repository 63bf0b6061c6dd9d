"""Registration, and the canonical views: as DataFrames and as the same thing in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.functions.columns import lookup
from tallyfield.operators import clean, index, stats

REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}  # noqa: F821


def query(name: str, sql: str | None = None):
    def register(f):
        assert name not in REGISTRY, name
        REGISTRY[name] = (f, sql)
        return f

    return register


CURRENCIES = list(params.RATES)
SECTORS = ["formal", "informal", "chain", "independent", "grocery"]
WEIGHTS = {f"NATION_{k}": round(0.15 + 0.05 * (k % 10), 2) for k in range(25)}
EXCLUDED, QUARANTINED = ["src4"], [("NATION_3", "src1"), ("NATION_7", "src2")]


class Tables:
    """The driver tables of one folder and the canonical views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self) -> str:
        """A new folder in spark.checkpoint.dir, which driver and executors share; only a local session without one gets a temporary one."""
        context = self.spark.sparkContext
        base = self.spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
        return f"{base.rstrip('/')}/query-{uuid.uuid4().hex}"

    def kept(self, df: DataFrame) -> DataFrame:
        """df written once to the shared folder and read from there: for what a query reads several times and is small beside its tables."""
        df.write.parquet(path := self.folder())
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def observations(self) -> DataFrame:
        """Price observations: the star of lineitem, part, supplier and nation."""
        pick = lambda key, values: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
        df = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey")).join(self.read("supplier").join(F.broadcast(self.read("nation")), F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
        key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.date_format("l_shipdate", "yyyy-MM-dd"))
        df = df.select(
            key.alias("obs_key"), F.col("s_name").alias("restaurant_name"), F.col("p_name").alias("item_name"), F.col("n_name").alias("country"), F.col("p_type").alias("category"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.to_date("l_shipdate").alias("collection_date"), pick("n_nationkey", CURRENCIES).alias("currency"), pick("s_suppkey", SECTORS).alias("sector"),
            F.concat(F.lit("src"), (F.col("l_linenumber") % 5).cast("string")).alias("source"), "l_linenumber", F.concat(F.lit("https://shop"), F.col("l_suppkey").cast("string"), F.lit(".example/menu/"), F.col("l_partkey").cast("string")).alias("url"),
        )
        usd = F.when(F.col("l_linenumber") % 3 != 0, F.col("price") / lookup("currency", params.RATES))
        return df.withColumn("price_usd", usd).withColumn("month", F.trunc("collection_date", "MM")).withColumn(
            "quality_signals", F.when(F.col("item_name").startswith("small"), '["PORTION_REDUCTION"]').when(F.col("item_name").startswith("large"), '["SIZE_INCREASE"]').when(F.col("item_name").startswith("hot"), '["PREMIUM_UPGRADE"]').otherwise("[]")
        )

    @cached_property
    def cleaned(self) -> DataFrame:
        """observations after backfill, sector names, excluded sources and quarantine."""
        df = clean.normalise_sector(clean.backfill_usd(self.observations))
        return clean.quarantine(clean.exclude_sources(df, EXCLUDED), QUARANTINED)

    @cached_property
    def capped(self) -> DataFrame:
        """At most ROW_CAP rows of each country and month, kept: every index reads them several times."""
        return self.kept(clean.cap_rows(self.cleaned, ["country", "month"], params.ROW_CAP, params.CAP_SEED, "obs_key"))

    @property
    def weights(self):
        return lookup("country", WEIGHTS, params.DEFAULT_INFORMAL_WEIGHT)

    @cached_property
    def panel(self) -> DataFrame:
        return index.monthly_panel(self.capped)

    @cached_property
    def median_index(self) -> DataFrame:
        return index.restaurant_median_index(self.capped, self.weights)

    @cached_property
    def cpi(self) -> DataFrame:
        """Mean order value by nation and month as a price series, urgent orders as its food part."""
        df = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        return df.groupBy(F.col("n_name").alias("country"), F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(F.avg("o_totalprice").alias("cpi"), F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("food"))

    @cached_property
    def lag_rows(self) -> DataFrame:
        """Lead/lag rows of the combined index's exact monthly changes against the CPI's: one a country and month, kept as all nulls read them."""
        from tallyfield.operators.series import calendar_lag

        change = lambda df, v: calendar_lag(df.where(F.col(v).isNotNull()), ["country"], v, 1).select("country", "month", (F.col(v) - F.col("before")).alias("v"))
        return self.kept(stats.lag1_rows(change(self.median_index, "combined_index"), change(self.cpi, "cpi"), ["country"]))

    @cached_property
    def posts(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("post_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("posted_at"), (F.col("event_type") == "error").alias("is_removed"),
            (F.col("event_type") == "purchase").alias("mentions_product"), (F.col("event_type") == "click").alias("claimed"), F.col("value").alias("upvotes"), "event_type",
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Answers of sources to queries: documents, dated over sixty days."""
        return self.read("documents").select(
            F.col("doc_id").alias("run_id"), (F.col("doc_id") % 20).alias("query_id"), F.concat(F.lit("kind"), (F.col("doc_id") % 3).cast("string")).alias("source"), F.expr("date_add(date'2024-01-01', cast(doc_id % 60 as int))").alias("run_date"), F.col("text").alias("raw_response"), "lang"
        )

    @cached_property
    def entities(self) -> DataFrame:
        return self.spark.createDataFrame(ENTITIES, "entity_id long, name string, entity_type string, aliases array<string>")

    @cached_property
    def mentions(self) -> DataFrame:
        from tallyfield.operators.mentions import mention_counts

        return mention_counts(self.runs, self.entities)


ENTITIES = [(1, "their", "brand", ["der", "los"]), (2, "that", "competitor", ["und", "que"]), (3, "with", "competitor", ["avec", "para"]), (4, "from", "competitor", ["von"])]

_RATE = "case currency " + " ".join(f"when '{c}' then {r}" for c, r in params.RATES.items()) + " end"
_WEIGHT = "case country " + " ".join(f"when '{c}' then {w}" for c, w in WEIGHTS.items()) + f" else {params.DEFAULT_INFORMAL_WEIGHT} end"
_LIST = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"

#: The canonical views as CTEs, in an order in which each needs only earlier ones.
CTES = {
    "raw": f"""raw as (select l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d') as obs_key, s_name as restaurant_name, p_name as item_name, n_name as country, p_type as category,
        l_extendedprice / l_quantity as price, cast(l_shipdate as date) as collection_date, {_LIST(CURRENCIES)}[n_nationkey % 11 + 1] as currency, {_LIST(SECTORS)}[s_suppkey % 5 + 1] as sector, 'src' || (l_linenumber % 5) as source, l_linenumber,
        'https://shop' || l_suppkey || '.example/menu/' || l_partkey as url
        from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)""",
    "obs": f"""obs as (select *, case when l_linenumber % 3 <> 0 then price / cast({_RATE} as double) end as price_usd, cast(date_trunc('month', collection_date) as date) as month,
        case when starts_with(item_name, 'small') then '["PORTION_REDUCTION"]' when starts_with(item_name, 'large') then '["SIZE_INCREASE"]' when starts_with(item_name, 'hot') then '["PREMIUM_UPGRADE"]' else '[]' end as quality_signals from raw)""",
    "cleaned": f"""cleaned as (select * exclude (price_usd, sector), coalesce(price_usd, price / cast({_RATE} as double)) as price_usd, case sector when 'chain' then 'formal' when 'independent' then 'informal' else sector end as sector from obs
        where sector <> 'grocery' and coalesce(price_usd, price) > 0 and source <> 'src4' and not (country = 'NATION_3' and source = 'src1') and not (country = 'NATION_7' and source = 'src2'))""",
    "capped": f"capped as (select * from cleaned qualify row_number() over (partition by country, month order by md5(obs_key || '{params.CAP_SEED}'), obs_key) <= {params.ROW_CAP})",
    "panel": "panel as (select country, sector, category, restaurant_name, item_name, month, median(price_usd) as price_usd, arg_min(quality_signals, obs_key) as quality_signals from capped group by all)",
    "medians": "medians as (select country, restaurant_name, sector, month, median(price_usd) as m, count(*) as n from capped group by all having median(price_usd) > 0)",
    "sectors": "sectors as (select country, sector, month, exp(avg(ln(m))) as g from medians group by all)",
    "based": "based as (select *, g / first_value(g) over (partition by country, sector order by month) * 100 as x from sectors)",
    "idx": f"""idx as (select a.country, a.month, f.x as formal_index, i.x as informal_index, coalesce(cast({_WEIGHT.replace('country', 'a.country', 1)} as double) * i.x + (1 - cast({_WEIGHT.replace('country', 'a.country', 1)} as double)) * f.x, f.x, i.x) as combined_index, a.item_count, a.restaurants
        from (select country, month, cast(sum(n) as bigint) as item_count, count(distinct restaurant_name) as restaurants from medians group by all) a
        left join based f on f.country = a.country and f.month = a.month and f.sector = 'formal' left join based i on i.country = a.country and i.month = a.month and i.sector = 'informal')""",
    "ranked": "ranked as (select *, dense_rank() over (partition by country order by month) as t from panel)",
    "ratios": """ratios as (select a.country, a.sector, a.category, a.month, quality_signals like '%PREMIUM%' or quality_signals like '%PORTION%' as adjusted, a.price_usd * (case when quality_signals like '%PREMIUM%' then 1 + -0.05 when quality_signals like '%PORTION%' then 1 + 0.08 else 1 end) / b.before as ratio
        from ranked a join (select country, sector, category, restaurant_name, item_name, t + 1 as t, price_usd as before from ranked) b using (country, sector, category, restaurant_name, item_name, t))""",
    "relatives": "relatives as (select country, sector, category, month, exp(avg(case when ratio > 0.01 and ratio < 100 then ln(ratio) end)) as price_relative, count(*) filter (ratio > 0.01 and ratio < 100) as item_count, count(*) filter (adjusted) as adjusted_count from ratios group by all having count(*) filter (ratio > 0.01 and ratio < 100) > 0)",
    "cpi": "cpi as (select n_name as country, cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as cpi, avg(case when o_orderpriority = '1-URGENT' then o_totalprice end) as food from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)",
    "dx": "dx as (select a.country, a.month, a.combined_index - b.combined_index as v from idx a join idx b on a.country = b.country and a.month = b.month + interval 1 month)",
    "dy": "dy as (select a.country, a.month, a.cpi - b.cpi as v from cpi a join cpi b on a.country = b.country and a.month = b.month + interval 1 month)",
    "lagrows": "lagrows as (select a.country, a.month, a.v as y, b.v as y1, x.v as x1 from dy a join dy b on a.country = b.country and a.month = b.month + interval 1 month join dx x on a.country = x.country and a.month = x.month + interval 1 month)",
    "posts": "posts as (select event_id as post_id, cast(user_id as varchar) as user_id, ts as posted_at, event_type = 'error' as is_removed, event_type = 'purchase' as mentions_product, event_type = 'click' as claimed, value as upvotes, event_type from events)",
    "runs": "runs as (select doc_id as run_id, doc_id % 20 as query_id, 'kind' || (doc_id % 3) as source, cast(date '2024-01-01' + cast(doc_id % 60 as integer) as date) as run_date, text as raw_response, lang from documents)",
    "entities": "entities(entity_id, name, entity_type, aliases) as (values " + ", ".join(f"({i}, '{n}', '{t}', {_LIST(a)})" for i, n, t, a in ENTITIES) + ")",
    "mentions": r"""mentions as (select run_id, query_id, source, run_date, cast(entity_id as bigint) as entity_id, name, entity_type, cast(len(list_filter(string_split_regex(lower(raw_response), '[^\p{L}\p{N}]+'), lambda w: list_contains(list_append(aliases, name), w))) as bigint) as n from runs cross join entities)""",
}
_NEEDS = {
    "raw": [], "obs": ["raw"], "cleaned": ["obs"], "capped": ["cleaned"], "panel": ["capped"], "medians": ["capped"], "sectors": ["medians"], "based": ["sectors"], "idx": ["based", "medians"], "ranked": ["panel"], "ratios": ["ranked"], "relatives": ["ratios"],
    "cpi": [], "dx": ["idx"], "dy": ["cpi"], "lagrows": ["dx", "dy"], "posts": [], "runs": [], "entities": [], "mentions": ["runs", "entities"],
}


def sql(views: str, body: str) -> str:
    """body behind a WITH of the named canonical views and what they need; body may go on with more CTEs after a comma."""
    need: set[str] = set()

    def add(name: str) -> None:
        for x in _NEEDS[name]:
            add(x)
        need.add(name)

    for name in views.split():
        add(name)
    return "with " + ",\n".join(CTES[n] for n in CTES if n in need) + "\n" + body


