"""Queries whose rows a stream makes: each runs over all that is there and returns the finished result."""

from __future__ import annotations


from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyfield.streaming import jobs

from .base import Tables, query, sql
from .prices import PRICE_INDEX, daily_prices, published


def _stream(t: Tables, table: str) -> DataFrame:
    schema = t.read(table).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir) if not _is_folder(t, table) else t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{table}.parquet")


def _is_folder(t: Tables, table: str) -> bool:
    """Whether the table is a folder of part files rather than one file."""
    return not t.read(table).select("_metadata.file_path").first()[0].endswith(f"/{table}.parquet")


def _finished(t: Tables, df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream writes when it has read what is there."""
    folder = t.folder()
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
        return t.spark.read.schema(df.schema).parquet(f"{folder}/out")

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out")

    df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{folder}/out")


def _events(t: Tables) -> DataFrame:
    return _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_alert_rates", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as start, event_type, count(*) as n from events group by all")
def _(t: Tables) -> DataFrame:
    out = _finished(t, jobs.alert_rates(_events(t), "1 hour", None, "30 days"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


_ALERT = "select strftime(s, '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from (select unnest([time_bucket({slide}, ts) - k * {slide} for k in range({times})]) as s, event_type from events where event_type in ({kinds})) group by all having count(*) > {least}"


def _alert(kinds: list[str], window: str, slide: str, times: int, least: int) -> str:
    return _ALERT.format(slide=f"interval {slide}", times=times, kinds=", ".join(f"'{k}'" for k in kinds), least=least)


def _alerts(t: Tables, kinds: list[str], window: str, slide: str, least: int) -> DataFrame:
    out = _finished(t, jobs.alerts(_events(t), kinds, window, slide, least, "30 days"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("stream_rejections", _alert(["error"], "1 hour", "15 minute", 4, 0))
def _(t: Tables) -> DataFrame:
    return _alerts(t, ["error"], "1 hour", "15 minutes", 0)


@query("stream_pauses", _alert(["click", "view", "purchase"], "15 minute", "5 minute", 3, 3))
def _(t: Tables) -> DataFrame:
    return _alerts(t, ["click", "view", "purchase"], "15 minutes", "5 minutes", 3)


@query("stream_errors", _alert(["error"], "5 minute", "1 minute", 5, 1))
def _(t: Tables) -> DataFrame:
    return _alerts(t, ["error"], "5 minutes", "1 minute", 1)


@query("stream_late_rows", "select event_id, event_type from events")
def _(t: Tables) -> DataFrame:
    """A day that is run again: what is there already is ignored."""
    folder = t.folder()
    for k in range(2):
        rows = _stream(t, "events").select("event_id", "event_type")
        jobs.late_policy(rows, f"{folder}/out", ["event_id"]).option("checkpointLocation", f"{folder}/at{k}").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_id long, event_type string").parquet(f"{folder}/out")


@query("stream_dedupe", "select user_id, event_type, count(*) as n from (select distinct user_id, event_type, cast(ts as date) as d from events) group by all")
def _(t: Tables) -> DataFrame:
    rows = _events(t).withColumn("d", F.to_date("ts"))
    out = _finished(t, jobs.stream_dedupe(rows, ["user_id", "event_type", "d"], "60 days"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, sid")
def _(t: Tables) -> DataFrame:
    out = _finished(t, jobs.sessions(_events(t), "2 hours", "30 days"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# streams with state of their own: the table is fed in several files, and the job is started anew, from its checkpoint, for each

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(t: Tables):
    was = t.spark.conf.get(_STORE, None)
    t.spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        t.spark.conf.unset(_STORE) if was is None else t.spark.conf.set(_STORE, was)


def _fed(t: Tables, batches: list[DataFrame], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that the job writes when the batches come one after the other and it is stopped and started again in between."""
    folder, schema = t.folder(), None
    with _rocksdb(t):
        for k, rows in enumerate(batches):
            rows.write.parquet(f"{folder}/in/batch{k}")
            out = job(t.spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
            schema = out.schema
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{folder}/out")


def _heartbeat(rows: DataFrame, time: str, days: int) -> DataFrame:
    """A row that holds nothing but a time, so many days behind the last: it moves the watermark past all others."""
    last = rows.agg(F.max(time).alias("last"))
    return last.select(*((F.col("last") + F.expr(f"interval {days} days") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))


@query("stream_price_changes", sql("obs", """, daily as (select restaurant_name, item_name, collection_date, avg(price) as price from obs group by all), p as (select *, lag(price) over (partition by restaurant_name, item_name order by collection_date) as old_price from daily)
select restaurant_name, item_name, collection_date, old_price, price as new_price, round((price - old_price) / old_price * 100, 4) as price_change_pct from p where old_price > 0 and abs(price - old_price) > 1e-6"""))
def _(t: Tables) -> DataFrame:
    """The days up to 1995 come first, but one item in seven of that year's last month comes late, with the days behind it."""
    daily = daily_prices(t).select("restaurant_name", "item_name", "collection_date", "price")
    late = F.col("collection_date").between("1995-12-05", "1995-12-31") & (F.pmod(F.xxhash64("item_name"), F.lit(7)) == 0)
    early = F.col("collection_date") <= "1995-12-31"
    pages = jobs.pages_for(t.read("lineitem").count())
    return _fed(t, [daily.where(early & ~late), daily.where(~early | late), _heartbeat(daily, "collection_date", 40)], lambda rows: jobs.stream_price_changes(rows, pages=pages))


def _posts(t: Tables) -> list[DataFrame]:
    """Posts in three files and a heartbeat of every user; one post in seven of the first file's last day comes late."""
    rows = t.posts.select("user_id", "post_id", "posted_at", "mentions_product", "is_removed")
    first, last = rows.agg(F.min("posted_at"), F.max("posted_at")).first()
    at = lambda k: F.lit(first + (last - first) * k / 3)
    late = (F.col("posted_at") > at(1) - F.expr("interval 1 day")) & (F.col("posted_at") <= at(1)) & (F.col("post_id") % 7 == 0)
    parts = [(F.col("posted_at") <= at(1)) & ~late, late | ((F.col("posted_at") > at(1)) & (F.col("posted_at") <= at(2))), F.col("posted_at") > at(2)]
    return [*(rows.where(p) for p in parts), _heartbeat(rows, "posted_at", 400).withColumn("user_id", F.lit(""))]


def _guarded(t: Tables) -> DataFrame:
    pages = jobs.pages_for(t.posts.count())
    return _fed(t, _posts(t), lambda posts: jobs.stream_guardrails(posts, pages=pages))


@query("stream_promo_cap", sql("posts", "select post_id, cast(sum(case when mentions_product then 1 else 0 end) over w as bigint) as promos, sum(case when mentions_product then 1 else 0 end) over w >= 3 as pause from posts window w as (partition by user_id order by posted_at range between interval '6 days 23 hours 59 minutes 59.999999 seconds' preceding and current row)"))
def _(t: Tables) -> DataFrame:
    return _guarded(t).where("kind = 'post'").select("post_id", "promos", "pause")


@query("stream_removal_rate", sql("posts", ", l as (select * from posts qualify row_number() over (partition by user_id order by posted_at desc, post_id desc) <= 10) select user_id, count(*) as posts, count(*) filter (is_removed) as removed, count(*) = 10 and count(*) filter (is_removed) / count(*) > 0.2 as pause from l group by all"))
def _(t: Tables) -> DataFrame:
    last = F.max_by(F.struct("posts", "removed", F.col("removal_pause").alias("pause")), F.struct("at", "post_id")).alias("x")
    return _guarded(t).where("kind = 'post'").groupBy("user_id").agg(last).select("user_id", "x.*")


@query("stream_pause_ends", sql("posts", """, times as (select user_id, posted_at, count(*) as came from posts where mentions_product group by all),
ends as (select user_id, came, posted_at + interval 7 day as ended from times),
held as (select e.user_id, e.ended, e.came, sum(t.came) as before from ends e join times t on t.user_id = e.user_id and t.posted_at >= e.ended - interval 7 day and t.posted_at < e.ended group by all)
select user_id, strftime(ended, '%Y-%m-%d %H:%M:%S') as ended from held where before >= 3 and before - came < 3"""))
def _(t: Tables) -> DataFrame:
    """The moments at which a pause ends because posts have left the window."""
    return _guarded(t).where("kind = 'resume'").select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("ended"))


@query("refresh_index", PRICE_INDEX)
def _(t: Tables) -> DataFrame:
    """The index after four batches: older rows; newer rows and rows that must go again; those go; and the last batch once more."""
    rows = t.cleaned.select("country", "month", "obs_key", "restaurant_name", "sector", "price_usd").withColumn("gone", F.lit(False))
    rows = t.kept(rows)  # five parts of the batches read it
    wrong = rows.where("month(month) = 2").withColumns({"obs_key": F.concat("obs_key", F.lit("|wrong")), "price_usd": F.col("price_usd") * 7, "month": F.add_months("month", 240)})
    old = F.col("month") < "1995-06-01"
    folder = t.folder()
    # whole countries come in one batch each but for those whose name ends in an even digit, which come month by month
    split = F.right("country", F.lit(1)).cast("int") % 2 == 0
    batches = [rows.where(old | ~split), rows.where(~old & split).unionByName(wrong), wrong.withColumn("gone", F.lit(True)), wrong.withColumn("gone", F.lit(True))]
    for k, part in enumerate(batches):
        part.write.parquet(f"{folder}/in/batch{k}")
        stream = t.spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        writer: DataStreamWriter = jobs.refresh_index(stream, f"{folder}/tables", t.weights, months=24)
        writer.option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return published(jobs.refreshed_index(t.spark, f"{folder}/tables"))
