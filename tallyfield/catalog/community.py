"""Queries of feeds, gates, user statistics and task state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield import params
from tallyfield.operators import community

from .base import Tables, query, sql

NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query("fresh_candidates", sql("posts", "select post_id, user_id from (select * from posts order by posted_at, post_id limit 500) where post_id % 3 <> 0"))
def _(t: Tables) -> DataFrame:
    return community.fresh_candidates(t.posts, t.posts.where("post_id % 3 = 0"), "post_id", ["posted_at", "post_id"], 500).select("post_id", "user_id")


@query("cycle_counters", sql("posts", "select count(*) as fetched, count(*) filter (upvotes > 50) as keyword_hits, count(*) filter (upvotes > 50 and post_id % 3 = 0) as skipped_duplicate from posts"))
def _(t: Tables) -> DataFrame:
    return community.cycle_counters(t.posts, F.col("upvotes") > 50, t.posts.where("post_id % 3 = 0"), "post_id")


_OPPS = "with op as (select o_orderkey as id, o_orderpriority as subreddit, cast(o_orderkey * 37 % 101 as bigint) as score, o_orderstatus as status from orders)"


def _opps(t: Tables) -> DataFrame:
    return t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subreddit"), (F.col("o_orderkey") * 37 % 101).cast("long").alias("score"), F.col("o_orderstatus").alias("status"))


@query("list_opportunities", _OPPS + " select * from op where subreddit = '2-HIGH' and score >= 40 and status = 'O' order by score desc, id desc limit 30 offset 10")
def _(t: Tables) -> DataFrame:
    return community.list_opportunities(_opps(t), "2-HIGH", 40, "O", 30, 10)


_KIND = "case o_orderkey % 3 when 0 then 'reddit_reply' when 1 then 'reddit_post' else 'content_gap' end"


@query("eligible_tasks", f"with tk as (select o_orderkey as task_id, {_KIND} as kind, 'sub' || (o_orderkey % 7) as sub from orders where o_orderstatus = 'O'), su as (select distinct 'u' || (c_custkey % 20) as user_id, 'sub' || (c_custkey % 11) as sub from customer where c_custkey % 2 = 0) select user_id, task_id, 'gated' as section from tk join su using (sub) where kind like 'reddit%' union all select null, task_id, 'content' from tk where kind not like 'reddit%'")
def _(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "reddit_reply").when(key % 3 == 1, "reddit_post").otherwise("content_gap")
    tasks = t.read("orders").select(key.alias("task_id"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.concat(F.lit("sub"), (key % 7).cast("string")).alias("suggested_subreddit"))
    c = F.col("c_custkey")
    subs = t.read("customer").select(F.concat(F.lit("u"), (c % 20).cast("string")).alias("user_id"), F.concat(F.lit("sub"), (c % 11).cast("string")).alias("subreddit"), (c % 2 == 0).alias("matches_expertise"))
    return community.eligible_tasks(tasks, subs)


PHRASES = ["Disclosure:", "of the", "[brand] the"]


def _held(brands: str, phrases=PHRASES) -> str:
    low = [p.lower() for p in phrases]
    return "list_filter(list_concat(" + "[" + ", ".join(f"'{p}'" for p in low if "[brand]" not in p) + "], " + ", ".join(f"list_transform({brands}, lambda b: replace('{p}', '[brand]', lower(b)))" for p in low if "[brand]" in p) + "), lambda p: contains(lower(text), p))"


@query("disclosures", f"select doc_id, list_aggregate({_held('b')}, 'string_agg', '|') as phrases from (select doc_id, text, case when doc_id % 2 = 0 then ['Of', 'in'] else []::varchar[] end as b from documents)")
def _(t: Tables) -> DataFrame:
    posts = t.read("documents").withColumn("b", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Of"), F.lit("in"))).otherwise(F.array().cast("array<string>")))
    found = F.array_join("accepted_phrases", "|")
    return community.disclosures(posts, "text", PHRASES, "b").select("doc_id", F.nullif(found, F.lit("")).alias("phrases"))


@query("disclosure_gate", f"""with m as (select doc_id, text, list_filter(['that', 'with'], lambda x: contains(lower(text), x)) as found, doc_id % 4 = 0 as reported from documents), n as (select *, len(found) > 0 or reported as mentions, case when len(found) > 0 then found else ['that', 'with'] end as b from m),
 h as (select doc_id, mentions, case when mentions then {_held('b')} else []::varchar[] end as held from n) select doc_id, mentions as mentions_product, cast(len(held) as bigint) as phrases, case when mentions and len(held) = 0 then 'disclosure_required' else 'ok' end as verdict from h""")
def _(t: Tables) -> DataFrame:
    found = F.filter(F.array(F.lit("that"), F.lit("with")), lambda x: F.lower("text").contains(x))
    posts = t.read("documents").withColumn("found", found).withColumn("reported", F.col("doc_id") % 4 == 0)
    out = community.disclosure_gate(posts, "text", "found", "reported", ["that", "with"], PHRASES)
    return out.select("doc_id", "mentions_product", F.size("accepted_phrases").cast("long").alias("phrases"), "verdict")


@query("eligibility", """with op as (select o_orderkey as opportunity_id, 'sub' || (o_orderkey % 4) as subreddit from orders where o_orderkey % 5 <> 0), rq as (select o_orderkey as opportunity_id, o_custkey as user_id from orders), pr as (select o_custkey as user_id, count(*) as promos from orders where o_orderstatus = 'P' group by all),
 cu as (select c_custkey as user_id, c_custkey % 13 = 0 as is_paused, 'sub' || (c_custkey % 4) as own, c_custkey % 3 <> 0 as fits from customer)
 select rq.user_id, rq.opportunity_id, case when is_paused then 'paused' when op.subreddit is null then 'no_opportunity' when own is distinct from op.subreddit then 'not_preexisting_active' when not fits then 'not_expertise_match' when promos >= 3 then 'weekly_promo_cap' else 'ok' end as reason
 from rq left join cu on cu.user_id = rq.user_id left join op on op.opportunity_id = rq.opportunity_id left join pr on pr.user_id = rq.user_id""")
def _(t: Tables) -> DataFrame:
    o, c = t.read("orders"), F.col("c_custkey")
    sub = lambda x: F.concat(F.lit("sub"), (x % 4).cast("string")).alias("subreddit")
    customers = t.read("customer")
    return community.eligibility(
        o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("opportunity_id")),
        customers.select(c.alias("user_id"), (c % 13 == 0).alias("is_paused")),
        o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("opportunity_id"), sub(F.col("o_orderkey"))),
        customers.select(c.alias("user_id"), sub(c), (c % 3 != 0).alias("matches_expertise")),
        o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("promos")),
    )


@query("user_stats", sql("posts", f""", cl as (select user_id, count(*) filter (event_type = 'click') as claimed, count(*) filter (event_type = 'purchase') as posted from posts where event_type in ('click', 'purchase') group by all), up as (select user_id, sum(upvotes) as upvotes from posts where posted_at >= timestamp '{NOW}' - interval 30 day group by all),
 rm as (select user_id, avg(case when is_removed then 1.0 else 0.0 end) as removal_rate, count(*) as removal_window from (select * from posts qualify row_number() over (partition by user_id order by posted_at desc, post_id desc) <= 10) group by all), ka as (select user_id, arg_max(upvotes, posted_at) as karma, count(*) as snapshots from posts where post_id % 7 = 0 group by all)
 select user_id, coalesce(claimed, 0) as claimed, coalesce(posted, 0) as posted, round(coalesce(upvotes, 0), 2) as upvotes, coalesce(removal_rate, 0) as removal_rate, coalesce(removal_window, 0) as removal_window, karma, coalesce(snapshots, 0) as snapshots from rm left join cl using (user_id) left join up using (user_id) left join ka using (user_id)"""))
def _(t: Tables) -> DataFrame:
    p = t.posts
    claims = p.where(F.col("event_type").isin("click", "purchase")).select("user_id", F.when(F.col("event_type") == "click", "claimed").otherwise("posted").alias("state"))
    karma = p.where("post_id % 7 = 0").select("user_id", F.col("posted_at").alias("taken_at"), F.col("upvotes").alias("total"))
    return community.user_stats(claims, p, karma, _now()).withColumn("upvotes", F.round("upvotes", 2))


@query("active_communities", sql("posts", """, hi as (select user_id, 'sub' || (post_id % 9) as subreddit, posted_at as seen, event_type = 'click' as sent from posts), ne as (select user_id, subreddit, count(*) filter (sent) as posts, count(*) filter (not sent) as comments, min(seen) as f, max(seen) as l from hi where seen < timestamp '2024-01-10 00:00:00' + to_days(cast(cast(user_id as bigint) % 10 as integer)) group by all),
 st as (select distinct user_id, 'sub3' as subreddit from posts where cast(user_id as bigint) % 4 = 0) select coalesce(ne.user_id, st.user_id) as user_id, coalesce(ne.subreddit, st.subreddit) as subreddit, coalesce(posts, 1) as posts, coalesce(comments, 2) as comments, strftime(case when st.user_id is null then f else timestamp '2020-01-01 00:00:00' end, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(case when ne.user_id is null then timestamp '2020-02-01 00:00:00' else l end, '%Y-%m-%d %H:%M:%S') as last_seen from ne full join st on st.user_id = ne.user_id and st.subreddit = ne.subreddit"""))
def _(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("long")
    history = t.posts.select("user_id", F.concat(F.lit("sub"), (F.col("post_id") % 9).cast("string")).alias("subreddit"), F.col("posted_at").alias("at"), F.when(F.col("event_type") == "click", "submitted").otherwise("comment").alias("kind"))
    users = t.posts.select("user_id").distinct()
    cutoffs = users.withColumn("cutoff", F.lit("2024-01-10 00:00:00").cast("timestamp") + F.make_dt_interval((user % 10).cast("int")))
    stored = users.where(user % 4 == 0).select("user_id", F.lit("sub3").alias("subreddit"), F.lit(1).cast("long").alias("posts"), F.lit(2).cast("long").alias("comments"), F.lit("2020-01-01").cast("timestamp").alias("first_seen"), F.lit("2020-02-01").cast("timestamp").alias("last_seen"))
    return community.active_communities(history, cutoffs, stored).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


_LE = ", ".join(map(str, params.LATENCY_BUCKETS))


@query("latency_histogram", sql("posts", f", g as (select date_diff('second', lag(posted_at) over (partition by user_id order by posted_at, post_id), posted_at) as s from posts) select cast(le as varchar) as le, count(*) as n from g, (select unnest([{_LE}]) as le) where s is not null and s <= le group by le union all select '+Inf', count(*) from g where s is not null"))
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    gap = F.unix_timestamp("posted_at") - F.unix_timestamp(F.lag("posted_at").over(Window.partitionBy("user_id").orderBy("posted_at", "post_id")))
    return community.latency_histogram(t.posts.withColumn("gap", gap), F.col("gap"))


@query("due_requests", f"select c_custkey, strftime(timestamp '2023-12-01 00:00:00' + to_days(cast(c_custkey % 90 + 30 as integer)), '%Y-%m-%d') as scheduled_for from customer where c_custkey % 2 = 0 and c_custkey % 3 = 0 and timestamp '2023-12-01 00:00:00' + to_days(cast(c_custkey % 90 + 30 as integer)) <= timestamp '{NOW}'")
def _(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    asked = F.lit("2023-12-01 00:00:00").cast("timestamp") + F.make_dt_interval((c % 90).cast("int"))
    requests = t.read("customer").select("c_custkey", asked.alias("requested_at"), F.when(c % 2 == 0, "delete").otherwise("export").alias("kind"), F.when(c % 3 == 0, "pending").otherwise("done").alias("status"))
    return community.due_requests(requests, _now()).select("c_custkey", F.date_format("scheduled_for", "yyyy-MM-dd").alias("scheduled_for"))


@query("marker_count", "select doc_id, doc_id % 4 + cast(len(regexp_extract_all(text, '\\[VERIFY:[^\\]]*\\]')) as bigint) as n from documents")
def _(t: Tables) -> DataFrame:
    body = F.concat(F.repeat(F.lit("[VERIFY: when] "), (F.col("doc_id") % 4).cast("int")), "text")
    return t.read("documents").select("doc_id", community.marker_count(body).alias("n"))


_STATUS = "case event_type when 'click' then 'edited' when 'purchase' then 'published' when 'error' then 'discarded' else 'draft' end"


@query("draft_transitions", sql("posts", f", ev as (select user_id, {_STATUS} as status, lag({_STATUS}) over (partition by user_id order by posted_at, post_id) as before from posts) select user_id, count(*) as steps, count(*) filter (before is null and status = 'draft' or before = 'draft' and status in ('edited', 'published', 'discarded') or before = 'edited' and status in ('published', 'discarded')) as legal from ev group by all"))
def _(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    events = t.posts.withColumn("status", F.when(kind == "click", "edited").when(kind == "purchase", "published").when(kind == "error", "discarded").otherwise("draft"))
    return community.draft_transitions(events, "user_id", "status", "posted_at", "post_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if("legal").alias("legal"))


@query("active_drafts", "select o_custkey, o_orderpriority, o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F' qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) = 1")
def _(t: Tables) -> DataFrame:
    drafts = t.read("orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", "o_orderdate")
    return community.active_drafts(drafts, ["o_custkey", "o_orderpriority"], "o_orderstatus", "o_orderdate", "o_orderkey", ("F",)).drop("o_orderdate")


_AT = "strftime(l_shipdate, '%Y-%m-%d') || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"


@query("apply_transitions", f"""with up as (select l_orderkey as task_id, arg_max(l_linestatus, {_AT}) as status, arg_max(case when l_returnflag = 'R' then 'returned' end, {_AT}) filter (l_returnflag = 'R') as reason from lineitem group by all)
 select o_orderkey as task_id, coalesce(status, o_orderstatus) as status, coalesce(reason, case when o_orderkey % 2 = 0 then 'old' end) as dismiss_reason, case when o_orderkey % 3 = 0 then o_orderkey else 1000000000 + o_orderkey end as opportunity_id from orders left join up on task_id = o_orderkey""")
def _(t: Tables) -> DataFrame:
    at = F.concat_ws("|", F.date_format("l_shipdate", "yyyy-MM-dd"), *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")))
    updates = t.read("lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linestatus").alias("status"), F.when(F.col("l_returnflag") == "R", "returned").alias("reason"), at.alias("at"))
    key = F.col("o_orderkey")
    tasks = t.read("orders").select(key.alias("task_id"), F.col("o_orderstatus").alias("status"), F.when(key % 2 == 0, "old").alias("dismiss_reason"), F.when(key % 3 == 0, key).alias("finder_opportunity_id"))
    return community.apply_transitions(tasks, updates).select("task_id", "status", "dismiss_reason", "opportunity_id")


@query("top_comments", "select conv_id, turn as comment_id, rk as rank, score, case when length(text) > 80 then rtrim(left(text, 79)) || '…' else text end as body from (select *, cast(length(text) % 17 as bigint) as score, row_number() over (partition by conv_id order by length(text) % 17 desc, turn) as rk from conversations) where rk <= 3 and length(text) > 0")
def _(t: Tables) -> DataFrame:
    comments = t.read("conversations").select("conv_id", F.col("turn").alias("comment_id"), (F.length("text") % 17).alias("score"), F.col("text").alias("body"))
    return community.top_comments(comments, "conv_id", 3, 80)


@query("backfill_mentions", r"with n as (select doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}])(that|with)([^\p{L}\p{N}]|$)') as now from documents) select doc_id, now as mentions_product, now <> (doc_id % 2 = 0) as changed from n")
def _(t: Tables) -> DataFrame:
    posts = t.read("documents").select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("mentions_product"))
    return community.backfill_mentions(posts, ["that", "with"], "text").select("doc_id", "mentions_product", "changed")
