"""Structured Streaming jobs: price changes, alert rates, deduplication, index refresh, guardrails and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyfield import params
from tallyfield.operators import clean, index

DAY_MS, DAY_US = 86_400_000, 86_400_000_000
#: Days after which nothing is idle.
NEVER = 100_000
#: Rows of a stream that a page gets in all, so that what a worker holds does not grow with the stream.
PAGE_ROWS = 50_000


def pages_for(rows: int) -> int:
    """Pages for a stream of about so many rows."""
    return max(64, -(-rows // PAGE_ROWS))


class _PricePage(StatefulProcessor):
    """The last settled price of every item of one page, and the rows that the watermark has not passed."""

    def __init__(self, idle_days: int):
        self.idle_days = idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self._settled(pd.concat(list(rows)), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(None, timerValues)

    def _settled(self, rows: pd.DataFrame | None, timer_values) -> pd.DataFrame:
        now, item = timer_values.getCurrentWatermarkInMs(), ["restaurant_name", "item_name"]
        columns = [*item, "at", "price", "settled"]
        parts = [pd.DataFrame({c: [] for c in columns}).astype({"at": "int64", "price": "float64", "settled": "bool"})]
        if self.page.exists():
            parts.append(pa.ipc.open_stream(self.page.get()[0]).read_pandas())
        if rows is not None:
            parts.append(rows.dropna(subset=["price", *item]).assign(settled=False)[columns])
        d = pd.concat([x for x in parts if len(x)] or parts)
        d = d.sort_values([*item, "at", "settled", "price"], ascending=[True, True, True, False, True], kind="stable").drop_duplicates([*item, "at"])
        done = d[d["at"] <= now]
        same = (done[item] == done[item].shift()).all(axis=1)
        old = done["price"].shift().where(same)
        found = ~done["settled"] & (old > 0) & ((done["price"] - old).abs() > 1e-6)
        out = done.loc[found, [*item, "at"]].assign(old_price=old[found], new_price=done.loc[found, "price"])
        last = done.drop_duplicates(item, keep="last").assign(settled=True)
        open_ = d[d["at"] > now]
        waiting = {*zip(open_["restaurant_name"], open_["item_name"], strict=True)}
        named = [x in waiting for x in zip(last["restaurant_name"], last["item_name"], strict=True)]
        kept = pd.concat([last[(last["at"] >= now - self.idle_days * DAY_MS) | np.array(named, bool)], open_])
        if len(kept):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(kept[columns], preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as to:
                to.write_table(table)
            self.page.update((sink.getvalue().to_pybytes(),))
        else:
            self.page.clear()
        wake = [int(open_["at"].min())] if len(open_) else []
        if len(last) and self.idle_days < NEVER:
            wake.append(int(last["at"].min()) + self.idle_days * DAY_MS + 1)
        for at in wake:
            if at > now:
                self.handle.registerTimer(at)
        return out[[*item, "at", "old_price", "new_price"]].astype(dict.fromkeys(item, object))  # plain strings, not several Arrow chunks

    def close(self) -> None:
        pass


def stream_price_changes(daily: DataFrame, delay: str = "30 days", idle_days: int = NEVER, pages: int = 64) -> DataFrame:
    """Price changes of a stream of (restaurant_name, item_name, collection_date, price): each day's price against the item's day before.

    Rows wait until the watermark, `delay` behind the latest day, has passed their day, and are then
    compared in order of days: a row that comes late, but within the delay, changes the result as if
    it had come in time; a later one is dropped. Of several prices of an item and day the smallest
    counts. Items are dealt to `pages` by a hash; a page's state is one value (last settled rows and
    waiting rows), read and written once a batch, and an event-time timer settles pages that get no
    rows. An item without a row for idle_days is forgotten. Rows without an item or a price only
    move the watermark. Needs the RocksDB state store.
    """
    rows = daily.select(
        F.coalesce(F.pmod(F.xxhash64("restaurant_name", "item_name"), F.lit(pages)), F.lit(0)).alias("page"), "restaurant_name", "item_name",
        F.col("collection_date").cast("timestamp").alias("ts"), F.col("price").cast("double").alias("price"),
    ).withWatermark("ts", delay)
    rows = rows.withColumn("at", F.unix_millis("ts"))
    out = rows.groupBy("page").transformWithStateInPandas(_PricePage(idle_days), "restaurant_name string, item_name string, at long, old_price double, new_price double", "Append", "EventTime")
    pct = F.round((F.col("new_price") - F.col("old_price")) / F.col("old_price") * 100, 4)
    return out.select("restaurant_name", "item_name", F.timestamp_millis("at").cast("date").alias("collection_date"), "old_price", "new_price", pct.alias("price_change_pct"))


def alert_rates(events: DataFrame, window: str, slide: str | None, delay: str) -> DataFrame:
    """Events by window and type; late ones within the delay count. events: (ts timestamp, event_type)."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def alerts(events: DataFrame, kinds: list[str], window: str, slide: str | None, more_than: int, delay: str) -> DataFrame:
    """(start, event_type, n) of the windows in which a kind of event comes more than so many times."""
    return alert_rates(events.where(F.col("event_type").isin(*kinds)), window, slide, delay).where(F.col("n") > more_than)


def late_policy(stream: DataFrame, target: str, keys: list[str]):
    """A writer that appends what `target` (a Parquet table) lacks by the keys, so that a day may be run again and late rows still count once."""

    def batch(rows: DataFrame, _: int) -> None:
        spark, fresh = rows.sparkSession, rows.dropDuplicates(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.schema(rows.schema).parquet(target).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch)


def stream_dedupe(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first event of each business key within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of a user: events without a gap between them."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def _upto(user: np.ndarray, at: np.ndarray, users: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many rows, in order of user and time, are at or before each (user, time) asked for."""
    n = len(user)
    order = np.lexsort((np.r_[np.zeros(n, bool), np.ones(len(users), bool)], np.r_[at, times], np.r_[user, users]))
    asked, out = order >= n, np.empty(len(users), np.int64)
    out[order[asked] - n] = np.cumsum(~asked)[asked]
    return out


class _GuardPage(StatefulProcessor):
    """Of all users of one page: product posts of the last days, last posts, and posts that the watermark has not passed."""

    COLUMNS = ["user_id", "at", "post_id", "product", "removed", "settled", "recent"]
    OUT = ["user_id", "kind", "at", "post_id", "promos", "pause", "posts", "removed", "removal_pause"]

    def __init__(self, cap: int, days: int, window: int, rate: float):
        self.cap, self.span, self.window, self.rate = cap, days * DAY_US, window, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "passed long, rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self._passed(pd.concat([d.loc[d["named"], self.COLUMNS[:5]] for d in rows]), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._passed(None, timerValues)

    def _passed(self, rows: pd.DataFrame | None, timer_values) -> pd.DataFrame:
        now, (before, old) = timer_values.getCurrentWatermarkInMs() * 1000, self.page.get() if self.page.exists() else (None, None)
        if rows is None and before == now:  # another timer of the same watermark
            return self._rows([])
        d = pa.ipc.open_stream(old).read_pandas() if old is not None else None
        if rows is not None and len(rows):
            rows = rows.assign(settled=False, recent=False)
            d = rows if d is None or d.empty else pd.concat([d, rows])
        if d is None:
            return self._rows([])
        out, kept = self._settled(d[self.COLUMNS], now, -(2**62) if before is None else before)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(kept, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as to:
            to.write_table(table)
        self.page.update((now, sink.getvalue().to_pybytes())) if len(kept) else self.page.clear()
        # the next moment at which a post has waited long enough, a pause can end or a product post has left the window
        over = kept.loc[kept["product"] & kept["settled"] & (kept["at"] > now - self.span), "at"] + self.span
        wake = [int(x.min()) for x in (kept.loc[~kept["settled"], "at"], over) if len(x)]
        if wake:
            self.handle.registerTimer(-(-min(wake) // 1000))
        return self._rows(out)

    def _settled(self, d: pd.DataFrame, now: int, before: int) -> tuple[list[dict], pd.DataFrame]:
        """What the posts up to `now` give, those up to `before` being settled, and the rows to keep."""
        user, names = pd.factorize(d["user_id"], use_na_sentinel=False)
        column = lambda c, kind: d[c].to_numpy(kind)
        at, post, product, removed, settled, recent = (column(c, k) for c, k in zip(self.COLUMNS[1:], ("int64", "int64", bool, bool, bool, bool), strict=True))
        order = np.lexsort((removed, product, post, ~settled, at, user))
        user, at, post, product, removed, settled, recent = (x[order] for x in (user, at, post, product, removed, settled, recent))
        # a post that comes twice counts once
        again = np.r_[False, (user[1:] == user[:-1]) & (at[1:] == at[:-1]) & (post[1:] == post[:-1]) & (product[1:] == product[:-1]) & (removed[1:] == removed[:-1]) & ~settled[1:] & ~settled[:-1]][: len(user)]
        user, at, post, product, removed, settled, recent = (x[~again] for x in (user, at, post, product, removed, settled, recent))
        done = ~settled & (at <= now)
        known = settled | done

        # product posts: a window's number is a difference of two running ones
        pu, pt = user[known & product], at[known & product]
        promos = lambda u, t: _upto(pu, pt, u, t)
        held = promos(user[done], at[done]) - promos(user[done], at[done] - self.span)
        first = np.r_[True, (pu[1:] != pu[:-1]) | (pt[1:] != pt[:-1])][: len(pu)]
        eu, et = pu[first], pt[first] + self.span
        ripe = (et > before) & (et <= now)
        eu, et = eu[ripe], et[ripe]
        full, left = promos(eu, et - 1) - promos(eu, et - self.span - 1), promos(eu, et - 1) - promos(eu, et - self.span)
        ends = (full >= self.cap) & (left < self.cap)
        eu, et, left = eu[ends], et[ends], left[ends]

        # the last posts: rows without gaps, so that a window is a slice
        chain = done | (settled & recent)
        cu, ct, seen = user[chain], at[chain], np.r_[0, np.cumsum(removed[chain])]

        def last(u: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin = np.maximum(np.searchsorted(cu, u), end - self.window)
            return end - begin, seen[end] - seen[begin]

        posts, gone = last(user[done], np.flatnonzero(done[chain]) + 1)
        end_posts, end_gone = last(eu, _upto(cu, ct, eu, et - 1))
        out = [
            {"user_id": names[user[done]], "kind": "post", "at": at[done], "post_id": post[done], "promos": held, "pause": held >= self.cap, "posts": posts, "removed": gone, "removal_pause": (posts == self.window) & (gone / posts > self.rate)},
            {"user_id": names[eu], "kind": "resume", "at": et, "post_id": None, "promos": left, "pause": False, "posts": end_posts, "removed": end_gone, "removal_pause": False},
        ]

        latest = np.zeros(len(user), bool)
        latest[chain] = np.searchsorted(cu, cu, "right") - np.arange(len(cu)) <= self.window
        keep = ~known | latest | (known & product & (at > now - self.span))
        kept = pd.DataFrame(dict(zip(self.COLUMNS, (x[keep] for x in (names[user], at, post, product, removed, known, latest)), strict=True)))
        return out, kept

    def _rows(self, parts: list[dict]) -> pd.DataFrame:
        kinds = {"user_id": object, "kind": object, "at": "int64", "post_id": "Int64", "promos": "int64", "pause": bool, "posts": "int64", "removed": "int64", "removal_pause": bool}
        frames = [pd.DataFrame(x, columns=self.OUT).astype(kinds) for x in parts if len(x["at"])]
        return pd.concat(frames) if frames else pd.DataFrame({c: [] for c in self.OUT}).astype(kinds)

    def close(self) -> None:
        pass


def stream_guardrails(posts: DataFrame, cap: int = params.PROMO_CAP, days: int = params.PROMO_DAYS, window: int = params.REMOVAL_WINDOW, rate: float = params.REMOVAL_RATE, delay: str = "2 days", pages: int = 64) -> DataFrame:
    """promo_cap() and removal_rate() over a stream of posts (user_id, post_id, posted_at, mentions_product, is_removed).

    One row of kind "post" per post, in event time: promos and pause as promo_cap() has them at its
    time, posts, removed and removal_pause over the user's last `window` posts up to it; and one of
    kind "resume" at the moment at which a pause ends because posts have left the window, whether or not
    the user posts again (an event-time timer fires then). Posts wait for the watermark, so a late
    one within the delay counts at its own time; repeated posts count once. Posts without a post_id
    only move the watermark. A user's state is bounded: the product posts of `days`, which a timer
    clears when they are over, `window` flags and the posts of `delay`. Users are dealt to `pages` by
    a hash; a page's state is one value, read and written once a batch, so a batch costs Python calls
    by pages, not by users. Needs the RocksDB state store.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    page = F.pmod(F.xxhash64("user_id"), F.lit(pages)).alias("page")
    post = [F.coalesce("post_id", F.lit(0)).cast("long").alias("post_id"), F.expr("post_id is not null and posted_at is not null").alias("named")]
    rows = posts.select(page, "user_id", *post, F.col("posted_at").alias("ts"), flag("mentions_product").alias("product"), flag("is_removed").alias("removed")).withWatermark("ts", delay)
    rows = rows.withColumn("at", F.coalesce(F.unix_micros("ts"), F.lit(0)))
    schema = "user_id string, kind string, at long, post_id long, promos long, pause boolean, posts long, removed long, removal_pause boolean"
    out = rows.groupBy("page").transformWithStateInPandas(_GuardPage(cap, days, window, rate), schema, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def refresh_index(stream: DataFrame, target: str, weights: Column, cap: int = params.ROW_CAP, seed: str = params.CAP_SEED, months: int = 1):
    """A writer that keeps the restaurant-median index of a stream of observations up to date; read it with refreshed_index().

    stream: cleaned observations with a unique obs_key and a boolean `gone`, which takes a row out
    again (of rows of a batch with one obs_key a gone one wins). Three tables lie under `target`,
    replaced by partitions:

    - rows (country, span): the observations; a span has `months` months. Only the spans that a batch
      touches are read and written.
    - sums (country, span): what the index needs of a month, by sector: count and sum of the logs of
      the restaurants' medians, items, restaurants; made from the touched spans' rows alone.
    - index (country): made from the sums of the touched countries, a few rows a month.

    A partition that a batch leaves empty is replaced by a row without content, so a month that
    vanishes from the observations vanishes from the index. Rows are put by obs_key and tables
    by partition, so a batch that is run again, or one that a crash cut short, ends in the same tables.
    """
    kinds = {"country": "string", "span": "int", "month": "date", "obs_key": "string", "restaurant_name": "string", "sector": "string", "price_usd": "double"}
    sums = {"country": "string", "span": "int", "month": "date"} | index.SUMS
    place, span = ["country", "span"], F.floor((F.year("month") * 12 + F.month("month") - 1) / months).cast("int")

    def replaced(df: DataFrame, name: str, by: list[str]) -> None:
        df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{target}/{name}")

    def read(spark: SparkSession, name: str, columns: dict[str, str]) -> DataFrame:
        path, schema = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}"), ", ".join(f"{c} {k}" for c, k in columns.items())
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(schema).parquet(f"{target}/{name}") if there else spark.createDataFrame([], schema)

    def marked(df: DataFrame, where: DataFrame) -> DataFrame:
        """df and a row without content for each partition of where, which is then replaced whatever df holds of it."""
        return df.unionByName(where.select(*(F.col(f.name) if f.name in where.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)))

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("span", span).select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), F.coalesce("gone", F.lit(False)).alias("gone"))
        rows = rows.where("country is not null and month is not null and obs_key is not null")
        own = F.struct("month", "restaurant_name", "sector", "price_usd", "gone")
        rows = rows.groupBy(*place, "obs_key").agg(F.max_by(own, F.struct("gone", own)).alias("x")).select(*place, "obs_key", "x.*").persist(StorageLevel.DISK_ONLY)
        try:
            touched = rows.select(*place).distinct()
            before = read(spark, "rows", kinds).join(touched, place, "left_semi").where("obs_key is not null")
            after = before.join(rows.select(*place, "obs_key"), [*place, "obs_key"], "left_anti").unionByName(rows.where("not gone").drop("gone"))
            replaced(marked(after, touched), "rows", place)
            now = read(spark, "rows", kinds).join(touched, place, "left_semi").where("obs_key is not null")
            fresh = index.sector_sums(clean.cap_rows(now, ["country", "month"], cap, seed, "obs_key")).withColumn("span", span)
            replaced(marked(fresh, touched), "sums", place)
            countries = touched.select("country").distinct()
            whole = read(spark, "sums", sums).join(countries, "country", "left_semi").where("sector is not null")
            replaced(marked(index.index_of_sums(whole, weights), countries), "index", ["country"])
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch)


def refreshed_index(spark: SparkSession, target: str) -> DataFrame:
    """The index that refresh_index() keeps."""
    schema = "country string, month date, item_count long, formal_index double, informal_index double, combined_index double, coverage_note string"
    return spark.read.schema(schema).parquet(f"{target}/index").where("month is not null")
