"""Queries over runs, mentions, posts and account health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import guardrails, mentions

from .base import Tables, query, sql
from .prices import R

def rows_of():
    """Number of rows, as an aggregate."""
    return F.count(F.lit(1))


@query("mention_counts", sql("mentions", "select run_id, entity_id, n from mentions"))
def _(t: Tables) -> DataFrame:
    return mentions.mention_counts(t.runs, t.entities, every=True).select("run_id", "entity_id", "n")


@query("find_mentions", sql("mentions", "select run_id, entity_id, count(*) as mentions from mentions, lateral (select unnest(range(n))) where n > 0 group by all"))
def _(t: Tables) -> DataFrame:
    return mentions.find_mentions(t.runs, t.entities, "raw_response").groupBy("run_id", "entity_id").agg(rows_of().alias("mentions"))


@query("detect_aliases", "select doc_id, concat_ws(',', case when regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the($|[^\\p{L}\\p{N}])') then 'the' end, case when regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])der($|[^\\p{L}\\p{N}])') then 'der' end) as matched from documents")
def _(t: Tables) -> DataFrame:
    return mentions.detect_aliases(t.read("documents"), "text", ["the", "der"]).select("doc_id", F.concat_ws(",", "matched").alias("matched"))


def _rows(t: Tables) -> DataFrame:
    """One row per (run, entity) that is mentioned."""
    m = t.mentions.where("n > 0")
    return m.withColumn("is_recommendation", F.col("n") >= 3).withColumn("rank", F.when(F.col("run_id") % 4 != 0, F.col("run_id") % 7 + 1))


_ROWS = ", rw as (select *, n >= 3 as is_recommendation, case when run_id % 4 <> 0 then run_id % 7 + 1 end as rank from mentions where n > 0)"


@query("share_of_voice", sql("mentions", _ROWS + ", s as (select source, entity_id, count(*) as mentions, count(*) filter (is_recommendation) as recommendations, avg(rank) as mean_rank from rw group by all) select source, entity_id, mentions, recommendations, round(mean_rank, 4) as mean_rank, round(mentions / sum(mentions) over (partition by source), 4) as share from s"))
def _(t: Tables) -> DataFrame:
    return mentions.share_of_voice(_rows(t)).select("source", "entity_id", "mentions", "recommendations", R("mean_rank"), R("share"))


for _bucket in ("day", "week"):

    def _trend(t: Tables, bucket=_bucket) -> DataFrame:
        return mentions.mention_trend(_rows(t), bucket)

    query(f"mention_trend_{_bucket}", sql("mentions", _ROWS + f" select cast(date_trunc('{_bucket}', run_date) as date) as bucket, entity_id, count(*) as mentions, count(*) filter (is_recommendation) as recommendations from rw group by all"))(_trend)


@query("parse_sentiment", "select doc_id, case when quality = 1 then 'positive' when toxic = 1 then 'negative' else 'neutral' end as sentiment, quality = 1 and toxic = 0 as is_recommendation from labels")
def _(t: Tables) -> DataFrame:
    """Replies that say what the labels say: with words around the object, without a field, and with a mood that is none."""
    good = F.concat(F.lit('Sure: {"sentiment": "Positive", "is_recommendation": '), (F.col("toxic") == 0).cast("string"), F.lit("}\nAnything else?"))
    reply = F.when(F.col("quality") == 1, good).when(F.col("toxic") == 1, '{"sentiment":"negative"}').otherwise('{"sentiment":"odd"}')
    return mentions.parse_sentiment(t.read("labels").withColumn("reply", reply), "reply").select("doc_id", "sentiment", "is_recommendation")


@query("cached_scores", "with c as (select doc_id, sha256(text) as text_hash from documents), k as (select distinct text_hash from c where doc_id % 3 = 0) select c.doc_id, k.text_hash is not null as hit from c left join k on k.text_hash = c.text_hash")
def _(t: Tables) -> DataFrame:
    ctx = t.read("documents").select("doc_id", F.lit(1).alias("entity_id"), F.col("text").alias("context"))
    cache = ctx.where("doc_id % 3 = 0").select(F.sha2("context", 256).alias("text_hash"), "entity_id", F.lit("neutral").alias("sentiment")).distinct()
    return mentions.cached_scores(ctx, cache).select("doc_id", F.col("sentiment").isNotNull().alias("hit"))


@query("cost_decisions", sql("runs", ", u as (select run_id, source, cast(run_id % 5 + 1 as bigint) as cost, coalesce(cast(sum(run_id % 5 + 1) over (partition by source, run_date order by run_id rows between unbounded preceding and 1 preceding) as bigint), 0) as used from runs) select run_id, used, source = 'kind2' or used + cost <= 8 as allowed from u"))
def _(t: Tables) -> DataFrame:
    return mentions.cost_decisions(t.runs.withColumn("cost_cents", F.col("run_id") % 5 + 1), {"kind0": 8, "kind1": 8}).select("run_id", "used", "allowed")


@query("url_parts", "select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, nullif(regexp_extract(url, '/r/([A-Za-z0-9_]+)(?:/|$)', 1), '') as community from pages")
def _(t: Tables) -> DataFrame:
    return mentions.url_parts(t.read("pages"), "url").select("page_id", "host", "community")


@query("ranked_mentions", sql("entities", r", it as (select conv_id as run_id, turn, text from conversations), rk as (select run_id, row_number() over (partition by run_id order by turn) as rank, text from it) select run_id, cast(entity_id as bigint) as entity_id, rank from rk cross join entities where len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: list_contains(list_append(aliases, name), w))) > 0"))
def _(t: Tables) -> DataFrame:
    items = t.read("conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("items"))
    return mentions.ranked_mentions(items, t.entities, "items")


@query("union_first", "select doc_id, min(p) as pass from (select doc_id, 0 as p from documents where doc_id % 2 = 0 union all select doc_id, 1 from documents where doc_id % 3 = 0) group by doc_id")
def _(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", "lang")
    return mentions.union_first([d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0")], "doc_id").select("doc_id", "pass")


_CITED = ", cited as (select p.page_id * 4 as run_id, 1 + p.page_id % 5 as place, url from pages p)"
_NOW = "2024-02-10"


def _cited(t: Tables) -> DataFrame:
    return t.read("pages").select((F.col("page_id") * 4).alias("run_id"), (1 + F.col("page_id") % 5).alias("place"), "url")


@query("gap_absent_brand", sql("mentions", _CITED + f""", rec as (select * from runs where run_date > date '{_NOW}' - 14), asked as (select distinct query_id from rec where source = 'kind0'),
 seen as (select distinct query_id, entity_id from mentions where n > 0 and source = 'kind0' and run_date > date '{_NOW}' - 14), ab as (select query_id, entity_id from asked cross join (select distinct entity_id from mentions where entity_type = 'brand') except select * from seen),
 lr as (select query_id, run_id from rec where source = 'kind1' qualify row_number() over (partition by query_id order by run_date desc, run_id desc) = 1)
 select distinct ab.query_id, ab.entity_id, c.url from ab join lr on lr.query_id = ab.query_id join cited c on c.run_id = lr.run_id where c.place <= 3 and ends_with(lower(regexp_extract(c.url, '^[a-z]+://([^/?#:]+)', 1)), 'example.com')"""))
def _(t: Tables) -> DataFrame:
    return mentions.gap_absent_brand(t.runs, t.mentions, t.entities, _cited(t), "kind0", "kind1", "example.com", F.lit(_NOW).cast("date")).select("query_id", "entity_id", "url")


_GAP2 = f""", cited as (select run_id, 1 + run_id % 2 as place, p.url from runs join pages p on p.page_id = run_id % 50), named as (select run_id from runs where regexp_matches(lower(raw_response), '(^|[^\\p{{L}}\\p{{N}}])(license|apache)($|[^\\p{{L}}\\p{{N}}])')), rec as (select * from runs where run_date > date '{_NOW}' - 14), tot as (select query_id, count(distinct run_id) as runs from rec where source = 'kind0' group by all),
 hit as (select query_id, entity_id, count(distinct run_id) as hits from mentions where source = 'kind0' and n > 0 and entity_type = 'competitor' and run_date > date '{_NOW}' - 14 group by all),
 lf as (select query_id, run_id from rec where source = 'kind2' qualify row_number() over (partition by query_id order by run_date desc, run_id desc) = 1),
 quiet as (select * from lf where run_id not in (select run_id from named)), th as (select run_id, min(url) as url from cited where place = 1 group by all),
 gap2 as (select query_id, entity_id, round(hits / runs, 4) as share, url from hit join tot using (query_id) join quiet using (query_id) join th using (run_id) where hits / runs >= 0.3)"""


def _gap2(t: Tables) -> DataFrame:
    """Competitors as elsewhere, the brand is what license lines name; every run cites a page."""
    brand = t.spark.createDataFrame([(9, "license", "brand", ["apache"])], t.entities.schema)
    counts = t.mentions.where("entity_type = 'competitor'").unionByName(mentions.mention_counts(t.runs, brand))
    urls = t.read("pages").select("url", F.col("page_id").alias("place"))
    cited = t.runs.select("run_id", (F.col("run_id") % 50).alias("place")).join(urls, "place").select("run_id", (1 + F.col("run_id") % 2).alias("place"), "url")
    return mentions.gap_dominant(t.runs, counts, cited, "kind0", "kind2", F.lit(_NOW).cast("date"), 0.3)


@query("gap_dominant", sql("mentions", _GAP2 + " select query_id, entity_id, share, url from gap2"))
def _(t: Tables) -> DataFrame:
    return _gap2(t).select("query_id", "entity_id", R("share"), "url")


@query("linked_tasks", sql("mentions", _GAP2 + ", op as (select url, min(page_id) as opportunity_id from pages where page_id % 2 = 0 group by all) select query_id, entity_id, gap2.url as related_url, opportunity_id from gap2 left join op on op.url = gap2.url"))
def _(t: Tables) -> DataFrame:
    """Gap tasks with the opportunities, every second page, that have their url."""
    found = t.read("pages").where("page_id % 2 = 0").select(F.col("page_id").alias("opportunity_id"), F.col("url").alias("post_url"))
    return mentions.linked_tasks(_gap2(t).select("query_id", "entity_id", F.col("url").alias("related_url")), found)


@query("new_tasks", "select doc_id % 50 as query_id, case when doc_id % 3 = 0 then null else 'u' || doc_id % 7 end as url, count(*) as n from documents d where not exists (select 1 from documents x where x.doc_id < 60 and x.doc_id % 50 = d.doc_id % 50 and (case when x.doc_id % 3 = 0 then null else 'u' || x.doc_id % 7 end) is not distinct from (case when d.doc_id % 3 = 0 then null else 'u' || d.doc_id % 7 end)) group by all")
def _(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", (F.col("doc_id") % 50).alias("query_id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string"))).alias("url"))
    return mentions.new_tasks(d, d.where("doc_id < 60"), ["query_id", "url"]).groupBy("query_id", "url").agg(rows_of().alias("n"))


@query("ingest_runs", sql("runs", "select query_id, source, run_date, min(run_id) as run_id from runs group by query_id, source, run_date"))
def _(t: Tables) -> DataFrame:
    r = t.runs.select("query_id", "source", "run_date", "run_id")
    return mentions.ingest_runs(r.limit(0), r)


_DAYS = "a as (select query_id, source, run_date, min(run_id) as run_id from runs where run_id % 2 = 0 group by all), b as (select query_id, source, run_date, max(-run_id) as minus, min(run_id) as run_id from runs where run_id % 3 = 0 group by all)"


@query("rerun_days", sql("runs", f", {_DAYS} select query_id, source, run_date, run_id, false as forced from a union all select query_id, source, run_date, run_id, false from b anti join a using (query_id, source, run_date) union all select query_id, source, run_date, run_id, true from b union all select query_id, source, run_date, run_id, true from a anti join b using (query_id, source, run_date)"))
def _(t: Tables) -> DataFrame:
    r = t.runs.select("query_id", "source", "run_date", "run_id")
    first = mentions.ingest_runs(r.limit(0), r.where("run_id % 2 = 0"))
    kept, forced = (mentions.ingest_runs(first, r.where("run_id % 3 = 0"), force).withColumn("forced", F.lit(force)) for force in (False, True))
    return kept.unionByName(forced)


@query("list_runs", sql("runs", "select run_id, source, run_date from runs where source = 'kind1' and run_date >= date '2024-02-01' order by run_date desc, run_id desc limit 50"))
def _(t: Tables) -> DataFrame:
    return t.runs.where("source = 'kind1' and run_date >= date'2024-02-01'").orderBy(F.desc("run_date"), F.desc("run_id")).limit(50).select("run_id", "source", "run_date")


# posts


@query("promo_cap", sql("posts", "select post_id, cast(sum(case when mentions_product then 1 else 0 end) over w as bigint) as promos, sum(case when mentions_product then 1 else 0 end) over w >= 3 as pause from posts window w as (partition by user_id order by posted_at range between interval '6 days 23 hours 59 minutes 59.999999 seconds' preceding and current row)"))
def _(t: Tables) -> DataFrame:
    return guardrails.promo_cap(t.posts).select("post_id", "promos", "pause")


@query("removal_rate", sql("posts", ", l as (select * from posts qualify row_number() over (partition by user_id order by posted_at desc, post_id desc) <= 10) select user_id, count(*) as posts, count(*) filter (is_removed) as removed, count(*) = 10 and count(*) filter (is_removed) / count(*) > 0.2 as pause from l group by all"))
def _(t: Tables) -> DataFrame:
    return guardrails.removal_rate(t.posts)


@query("resolve_claims", sql("posts", "select post_id, row_number() over (partition by post_id % 200 order by posted_at, post_id) = 1 as won from posts where claimed"))
def _(t: Tables) -> DataFrame:
    claims = t.posts.where("claimed").select((F.col("post_id") % 200).alias("opportunity_id"), F.col("posted_at").alias("claimed_at"), F.col("post_id").alias("claim_id"))
    return guardrails.resolve_claims(claims).select(F.col("claim_id").alias("post_id"), "won")


@query("apply_quota", sql("posts", "select post_id, row_number() over (partition by user_id, cast(posted_at as date) order by posted_at, post_id) as place, row_number() over (partition by user_id, cast(posted_at as date) order by posted_at, post_id) <= 2 as accepted from posts"))
def _(t: Tables) -> DataFrame:
    return guardrails.apply_quota(t.posts, 2).select("post_id", "place", "accepted")


@query("draft_state", sql("posts", ", e as (select *, lag(event_type) over (partition by user_id order by posted_at, post_id) as before from posts) select user_id, arg_max(event_type, (posted_at, post_id)) as state, count(*) as transitions, count(*) filter (event_type = before) as repeats from e group by all"))
def _(t: Tables) -> DataFrame:
    return guardrails.draft_state(t.posts, "user_id", "event_type", "posted_at", "post_id")


@query("feed", sql("posts", ", c as (select distinct post_id from posts where claimed) select post_id, upvotes as score from posts where upvotes >= 5 and cast(user_id as bigint) % 3 = 0 and post_id not in (select post_id from c) order by upvotes desc, post_id desc limit 100"))
def _(t: Tables) -> DataFrame:
    p = t.posts.withColumnsRenamed({"upvotes": "score"}).withColumn("community", F.col("user_id"))
    allowed = p.where(F.col("user_id").cast("long") % 3 == 0).select("community").distinct()
    return guardrails.feed(p, allowed, p.where("claimed").select("post_id"), 5.0, 100).select("post_id", "score")


@query("adjacent_communities", "with a as (select distinct user_id as author, 'c' || event_id % 23 as community from events), s as (select distinct author from a where community in ('c1', 'c2')) select community, count(*) as authors from a semi join s using (author) where community not in ('c1', 'c2') group by all order by authors desc, community limit 10")
def _(t: Tables) -> DataFrame:
    a = t.read("events").select(F.col("user_id").alias("author"), F.concat(F.lit("c"), (F.col("event_id") % 23).cast("string")).alias("community"))
    return guardrails.adjacent(a, ["c1", "c2"], 10)


@query("keyword_candidates", "select conv_id, turn from conversations where lower(text) like '%tion%' or lower(text) like '%und%'")
def _(t: Tables) -> DataFrame:
    return guardrails.keyword_candidates(t.read("conversations"), F.col("text"), ["TION", "und"]).select("conv_id", "turn")


@query("parse_scores", "select event_id, least(100.0, greatest(0.0, cast(props->>'k' as double) * 2 - 20)) as score from events where least(100.0, greatest(0.0, cast(props->>'k' as double) * 2 - 20)) >= 60")
def _(t: Tables) -> DataFrame:
    reply = F.concat(F.lit('{"score": '), (F.get_json_object("props", "$.k").cast("double") * 2 - 20).cast("string"), F.lit("}"))
    return guardrails.parse_scores(t.read("events").withColumn("reply", reply), "reply").select("event_id", "score")


@query("error_counts", "select case when event_type = 'error' then case when value < 25 then 'rate_limited' when value < 50 then 'timeout' when value < 75 then 'upstream_5xx' else 'other' end when event_type = 'view' then 'json_parse' when event_type = 'click' then 'schema_invalid' end as reason, count(*) as n from events group by all")
def _(t: Tables) -> DataFrame:
    """Errors by the event's value; clicks answer with their props, which hold no score, views with half of them."""
    kind, value = F.col("event_type"), F.col("value")
    status = F.when(kind == "error", F.when(value < 25, 429).when(value < 50, 408).when(value < 75, 503).otherwise(404)).otherwise(200)
    body = F.when(kind == "click", F.col("props")).when(kind == "view", F.left("props", F.lit(4))).otherwise('{"score": 3}')
    return t.read("events").select(guardrails.error_reason(status, body).alias("reason")).groupBy("reason").agg(rows_of().alias("n"))


@query("alias_variants", "select c_custkey, list_sort(list_distinct([n, lower(n), replace(n, ' ', ''), replace(lower(n), ' ', ''), replace(lower(n), ' ', '') || '.com', replace(lower(n), ' ', '') || '.io']))::varchar as variants from (select c_custkey, c_mktsegment || ' & Co' as n from customer)")
def _(t: Tables) -> DataFrame:
    names = t.read("customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" & Co")).alias("name"))
    return guardrails.alias_variants(names).select("c_custkey", F.concat(F.lit("["), F.array_join(F.transform("variants", lambda v: F.when(v.contains("&"), v).otherwise(v)), ", "), F.lit("]")).alias("variants"))


REGISTRY_OF_USERS = {"posts": guardrails.UserTable(), "orders": guardrails.UserTable("o_custkey", True, ("o_orderpriority",)), "profiles": guardrails.UserTable("c_custkey", True, ("c_name", "c_mktsegment"))}


def _user_tables(t: Tables) -> dict[str, DataFrame]:
    return {"posts": t.posts.select("post_id", "user_id", "event_type"), "orders": t.read("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), "profiles": t.read("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")}


def _erased(t: Tables) -> str:
    """The tables after requests of every fifth user, carried out twice, the second time with one request more."""
    folder = t.folder()
    guardrails.publish(t.spark, folder, _user_tables(t))
    users = t.posts.select("user_id").unionByName(t.read("customer").select(F.col("c_custkey").cast("string").alias("user_id"))).distinct()
    asked = users.where(F.col("user_id").cast("long") % 5 == 0).select(F.concat(F.lit("r"), "user_id").alias("request_id"), "user_id")
    guardrails.erase_users(t.spark, folder, REGISTRY_OF_USERS, asked.where("user_id <> '0'"))
    last = guardrails.erase_users(t.spark, folder, REGISTRY_OF_USERS, asked)
    assert guardrails.erase_users(t.spark, folder, REGISTRY_OF_USERS, asked) == last  # nothing is left to do
    return folder


@query("erase_users", sql("posts", "select post_id, user_id, event_type from posts where cast(user_id as bigint) % 5 <> 0"))
def _(t: Tables) -> DataFrame:
    return guardrails.current(t.spark, _erased(t), "posts")


@query("anonymise_users", "select 'orders' as \"table\", o_orderkey as key, case when o_custkey % 5 <> 0 then cast(o_custkey as varchar) end as user_id, case when o_custkey % 5 <> 0 then o_orderpriority end as personal, o_totalprice as kept from orders union all select 'profiles', c_custkey % 5, case when c_custkey % 5 <> 0 then cast(c_custkey as varchar) end, case when c_custkey % 5 <> 0 then c_name end, c_acctbal from customer")
def _(t: Tables) -> DataFrame:
    folder = _erased(t)
    orders = guardrails.current(t.spark, folder, "orders").select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("personal"), F.col("o_totalprice").alias("kept"))
    profiles = guardrails.current(t.spark, folder, "profiles").select(F.lit("profiles").alias("table"), F.coalesce(F.col("c_custkey") % 5, F.lit(0)).alias("key"), F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("personal"), F.col("c_acctbal").alias("kept"))
    return orders.unionByName(profiles)


@query("erasure_audit", sql("posts", ", u as (select user_id from posts union select cast(c_custkey as varchar) from customer), p as (select user_id, count(*) as n from posts group by all), o as (select o_custkey, count(*) as n from orders group by all) select 'r' || u.user_id as request_id, 'completed' as state, true as erased, coalesce(p.n, 0) as n_posts, coalesce(o.n, 0) as n_orders, case when c_custkey is null then 0 else 1 end as n_profiles from u left join p on p.user_id = u.user_id left join o on o.o_custkey = cast(u.user_id as bigint) left join customer on c_custkey = cast(u.user_id as bigint) where cast(u.user_id as bigint) % 5 = 0"))
def _(t: Tables) -> DataFrame:
    return guardrails.current(t.spark, _erased(t), "audit")


@query("export_bundle", sql("posts", ", u as (select distinct user_id from posts where event_type = 'signup') select user_id, 'posts' as \"table\", count(post_id) as n, coalesce(string_agg(cast(post_id as varchar) || ':' || event_type, ',' order by post_id), '') as held from u left join posts using (user_id) group by all union all select user_id, 'orders', count(o_orderkey), coalesce(string_agg(cast(o_orderkey as varchar) || ':' || o_orderpriority, ',' order by o_orderkey), '') from u left join orders on o_custkey = cast(user_id as bigint) group by all"))
def _(t: Tables) -> DataFrame:
    """The bundles of all users who signed up, read again from their JSON."""
    registry = {k: REGISTRY_OF_USERS[k] for k in ("posts", "orders")}
    out = guardrails.export_bundle(_user_tables(t), registry, t.posts.where("event_type = 'signup'").select("user_id"))
    rows = F.from_json("rows", "array<struct<post_id: long, event_type: string, o_orderkey: long, o_orderpriority: string>>")
    held = F.transform(F.array_sort(F.transform(rows, lambda r: F.struct(F.coalesce(r["post_id"], r["o_orderkey"]).alias("k"), F.coalesce(r["event_type"], r["o_orderpriority"]).alias("v")))), lambda r: F.concat(r["k"].cast("string"), F.lit(":"), r["v"]))
    return out.select("user_id", "table", "n", F.array_join(held, ",").alias("held"))


@query("within_range", sql("posts", "select r.post_id, count(e.post_id) as promos, coalesce(max(e.upvotes), 0) as most from posts r left join posts e on e.user_id = r.user_id and e.mentions_product and e.posted_at <= r.posted_at and e.posted_at > r.posted_at - interval 7 day where r.event_type = 'signup' group by all"))
def _(t: Tables) -> DataFrame:
    """Product posts in the week up to each sign-up of the same user."""
    from tallyfield.operators.clean import within_range

    asked = t.posts.where("event_type = 'signup'").select(F.col("post_id").alias("asked"), "user_id", F.col("posted_at").alias("asked_at"))
    pairs = within_range(t.posts.where("mentions_product").select("post_id", "user_id", "posted_at", "upvotes"), asked, ["user_id"], "posted_at", "asked_at", 7 * 86400)
    n = pairs.groupBy("asked").agg(rows_of().alias("promos"), F.max("upvotes").alias("most"))
    return asked.join(n, "asked", "left").select(F.col("asked").alias("post_id"), F.coalesce("promos", F.lit(0).cast("long")).alias("promos"), F.coalesce("most", F.lit(0.0)).alias("most"))


@query("failure_alert", sql("posts", "select user_id, count(*) as runs, round(count(*) filter (is_removed) / count(*), 4) as failure_rate, count(*) filter (is_removed) / count(*) >= 0.25 as alert from posts group by all"))
def _(t: Tables) -> DataFrame:
    from tallyfield.operators.quality import failure_alert

    return failure_alert(t.posts, "user_id", "is_removed", 0.25)


# health

_DAYS = ", dy2 as (select user_id, cast(posted_at as date) as d, count(*) as authed, count(*) filter (event_type in ('view', 'click')) as anon, max(posted_at) as checked_at from posts group by all), gp as (select *, case when authed <= 0 then 0 else greatest(0, (authed - anon) / authed) end as gap from dy2), an as (select *, gap > 0.3 as anomaly from gp)"


def _checks(t: Tables) -> DataFrame:
    by = t.posts.groupBy("user_id", F.to_date("posted_at").alias("d")).agg(rows_of().alias("authed"), F.count_if(F.col("event_type").isin("view", "click")).alias("anon"), F.max("posted_at").alias("checked_at"))
    return guardrails.visibility_gap(by)


_ESC = _DAYS + ", es as (select *, case when not anomaly then 'ok' when lag(anomaly) over w and checked_at - lag(checked_at) over w >= interval 1 day then 'alert' else 'warning' end as status from an window w as (partition by user_id order by checked_at))"


@query("visibility_gap", sql("posts", _DAYS + " select user_id, d, round(gap, 4) as gap, anomaly from an"))
def _(t: Tables) -> DataFrame:
    return _checks(t).select("user_id", "d", R("gap"), "anomaly")


@query("escalate", sql("posts", _ESC + " select user_id, d, status from es"))
def _(t: Tables) -> DataFrame:
    return guardrails.escalate(_checks(t)).select("user_id", "d", "status")


@query("health_state", sql("posts", _ESC + ", lo as (select *, max(checked_at) filter (status = 'ok') over (partition by user_id) as last_ok from es) select user_id, arg_max(status, checked_at) as status, strftime(min(checked_at) filter (status <> 'ok' and (last_ok is null or checked_at > last_ok)), '%Y-%m-%d %H:%M:%S') as suspected_at from lo group by all"))
def _(t: Tables) -> DataFrame:
    return guardrails.health_state(guardrails.escalate(_checks(t))).select("user_id", "status", F.date_format("suspected_at", "yyyy-MM-dd HH:mm:ss").alias("suspected_at"))


@query("highest_severity", sql("posts", _ESC + ", la as (select user_id, d % 2 as kind, status, checked_at from (select *, extract(day from d) as d2 from es) x, lateral (select cast(d2 as bigint) as d) y(d) qualify row_number() over (partition by user_id, y.d % 2 order by checked_at desc) = 1) select user_id, case max(case status when 'ok' then 1 when 'warning' then 2 else 3 end) when 1 then 'ok' when 2 then 'warning' else 'alert' end as severity from la group by all".replace("d % 2 as kind, status", "y.d % 2 as kind, status")))
def _(t: Tables) -> DataFrame:
    checks = guardrails.escalate(_checks(t)).withColumn("kind", F.dayofmonth("d") % 2)
    return guardrails.highest_severity(guardrails.latest_checks(checks.select("user_id", "kind", "status", "checked_at"), ["user_id", "kind"], "checked_at", "status"))


_KARMA = ", k as (select user_id, posted_at as taken_at, post_id, sum(case when is_removed then -40 else upvotes end) over (partition by user_id order by posted_at, post_id) as total from posts)"


def _karma(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("posted_at", "post_id")
    return t.posts.select("user_id", F.col("posted_at").alias("taken_at"), F.sum(F.when(F.col("is_removed"), -40).otherwise(F.col("upvotes"))).over(w).alias("total"))


@query("karma_trend", sql("posts", _KARMA + """, nw as (select timestamp '2024-01-31 00:00:00' as n), ag as (select user_id, arg_max(total, taken_at) as total, arg_max(total, taken_at) filter (taken_at <= n - interval 7 day) as week, arg_max(total, taken_at) filter (taken_at <= n - interval 14 day) as fortnight from k, nw group by all)
 select user_id, round(total, 2) as total, case when not coalesce(total - week <= -50 or (week > 0 and (week - total) / week >= 0.3), false) then 'ok' when coalesce(total - fortnight <= -50 or (fortnight > 0 and (fortnight - total) / fortnight >= 0.3), false) then 'alert' else 'warning' end as status from ag"""))
def _(t: Tables) -> DataFrame:
    return guardrails.karma_trend(_karma(t), F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id", F.round("total", 2).alias("total"), "status")


@query("removal_gaps", sql("posts", ", l as (select * from (select * from posts qualify row_number() over (partition by user_id order by posted_at desc, post_id desc) <= 30) where is_removed), g as (select user_id, (epoch_us(posted_at) - epoch_us(lag(posted_at) over (partition by user_id order by posted_at, post_id))) / 86400e6 as gap from l) select user_id, count(*) as removed, round(avg(gap), 6) as mean_gap, round(stddev_pop(gap), 6) as gap_deviation from g group by all"))
def _(t: Tables) -> DataFrame:
    out = guardrails.removal_gaps(t.posts)
    return out.select("user_id", "removed", F.round("mean_gap", 6).alias("mean_gap"), F.round("gap_deviation", 6).alias("gap_deviation"))


@query("slow_burn", sql("posts", ", l as (select * from posts qualify row_number() over (partition by user_id order by posted_at desc, post_id desc) <= 30) select user_id, count(*) as posts, count(*) filter (is_removed) as removed, coalesce(count(*) = 30 and count(*) filter (is_removed) / count(*) > 0.1 and count(*) filter (is_removed) >= 2 and max(posted_at) filter (is_removed) - min(posted_at) filter (is_removed) >= interval 7 day, false) as alert from l group by all"))
def _(t: Tables) -> DataFrame:
    return guardrails.slow_burn(t.posts)
