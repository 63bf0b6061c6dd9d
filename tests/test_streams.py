"""Streams with state: late rows, idle keys, restarts, vanished months."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import index
from tallyfield.streaming import jobs

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def feed(spark):
    """Runs a job over batches that come one after the other, started anew for each, and returns what each run wrote."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp(prefix="tallyfield-feed-")

    def run(batches, schema, job):
        seen, wrote = [], []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
            out = job(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
            every = sorted((tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()), key=repr)
            wrote.append([r for r in every if r not in seen])
            seen = every
        return wrote

    yield run
    spark.conf.unset(STORE)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_price_changes_wait_for_late_rows(feed):
    schema = "restaurant_name string, item_name string, collection_date date, price double"
    beat = lambda n: (None, None, day(n), None)
    first = [("r", "a", day(0), 10.0), ("r", "a", day(4), 12.0), ("r", "b", day(0), 5.0), ("r", "b", day(0), 4.0), beat(8)]
    late = [("r", "a", day(3), 11.0), ("r", "b", day(5), 4.0), beat(30)]
    too_late = [("r", "a", day(10), 99.0), ("r", "a", day(31), 6.0), ("r", "b", day(31), 8.0), beat(60)]
    wrote = feed([first, late, too_late], schema, lambda s: jobs.stream_price_changes(s, "7 days", pages=2))
    assert wrote[0] == []  # nothing that happened is more than seven days old
    assert [r[1:5] for r in wrote[1]] == [("a", day(3), 10.0, 11.0), ("a", day(4), 11.0, 12.0)]
    assert [r[1:5] for r in wrote[2]] == [("a", day(31), 12.0, 6.0), ("b", day(31), 4.0, 8.0)] and wrote[2][0][5] == -50.0


def test_idle_items_are_forgotten(feed):
    schema = "restaurant_name string, item_name string, collection_date date, price double"
    beat = lambda n: (None, None, day(n), None)
    wrote = feed([[("r", "a", day(0), 10.0), ("r", "b", day(0), 10.0), beat(10)], [("r", "b", day(12), 11.0), beat(40)], [("r", "a", day(41), 12.0), ("r", "b", day(41), 12.0), beat(90)]], schema, lambda s: jobs.stream_price_changes(s, "2 days", idle_days=30, pages=1))
    assert [[r[1:5] for r in w] for w in wrote] == [[], [("b", day(12), 10.0, 11.0)], [("b", day(41), 11.0, 12.0)]]


def test_guardrails(feed):
    schema = "user_id string, post_id long, posted_at timestamp, mentions_product boolean, is_removed boolean"
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    posts = [("u", 1, at(0), True, False), ("u", 3, at(2), True, True), ("v", 9, at(2), None, None), ("", None, at(4), None, None)]
    late = [("u", 2, at(2), True, False), ("u", 3, at(2), True, True), ("", None, at(6), None, None)]
    wrote = feed([posts, late, [("", None, at(30), None, None)]], schema, lambda s: jobs.stream_guardrails(s, window=2, rate=0.4, delay="3 days"))
    by = [[(r[1], r[2].day - 1, r[3], *r[4:]) for r in sorted(w, key=lambda r: (r[0], r[2], r[3] or 0)) if r[0] in "uv" and r[0]] for w in wrote]
    assert by[0] == [("post", 0, 1, 1, False, 1, 0, False)]
    # of the two posts of the second day the late one is counted with the other, and the copy once
    assert by[1] == [("post", 2, 2, 3, True, 2, 0, False), ("post", 2, 3, 3, True, 2, 1, True), ("post", 2, 9, 0, False, 1, 0, False)]
    assert by[2] == [("resume", 7, None, 2, False, 2, 1, False)]


def test_refreshed_index_forgets_vanished_months(spark):
    folder = tempfile.mkdtemp(prefix="tallyfield-refresh-")
    schema = "country string, month date, obs_key string, restaurant_name string, sector string, price_usd double, gone boolean"
    months = [dt.date(2024, m, 1) for m in range(1, 5)]
    rows = [("A", m, f"{m}{r}", f"r{r}", "formal" if r % 2 else "informal", 5.0 + i * r, None) for i, m in enumerate(months) for r in range(4)] + [("B", months[0], "x", "r", "formal", 3.0, False)]
    last = [r for r in rows if r[1] == months[3]]
    batches = [rows[:7], rows[7:] + rows[:2], [(*r[:6], True) for r in last], [(*r[:6], True) for r in last], [("B", months[0], "x", "r", "formal", 3.0, True)]]
    weights, wanted = F.lit(0.5), [rows[:7], rows, rows[:12] + rows[16:], rows[:12] + rows[16:], rows[:12]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        jobs.refresh_index(stream, f"{folder}/out", weights, months=2).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
        got = jobs.refreshed_index(spark, f"{folder}/out")
        want = index.restaurant_median_index(spark.createDataFrame(wanted[k], schema), weights).select(got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), k


def test_guardrails_by_pages(feed):
    """Users share pages, and each gets what a loop over its own posts gives."""
    import random

    schema, r, start = "user_id string, post_id long, posted_at timestamp, mentions_product boolean, is_removed boolean", random.Random(1), dt.datetime(2024, 1, 1)
    big = 2**53 + 1  # ids beyond what a double holds
    posts = [(f"u{r.randrange(9)}", big + i, start + dt.timedelta(hours=6 * r.randrange(120)), r.random() < 0.4, r.random() < 0.4) for i in range(300)]
    cut = lambda a, z: [p for p in posts if start + dt.timedelta(days=a) <= p[2] < start + dt.timedelta(days=z)]
    beat = [("", None, start + dt.timedelta(days=90), None, None)]
    wrote = feed([cut(0, 10), cut(10, 20) + cut(9, 10), cut(20, 31), beat], schema, lambda s: jobs.stream_guardrails(s, cap=2, days=3, window=4, rate=0.4, delay="3 days", pages=2))
    got = [x for w in wrote for x in w]
    span, want = dt.timedelta(days=3), []
    for u in {p[0] for p in posts}:
        own = sorted(p[1:] for p in posts if p[0] == u)
        own.sort(key=lambda p: (p[1], p[0]))
        for i, (post, at, _, _) in enumerate(own):
            promos, recent = sum(p[2] for p in own if at - span < p[1] <= at), [p[3] for p in own[max(0, i - 3) : i + 1]]
            want.append((u, "post", at, post, promos, promos >= 2, len(recent), sum(recent), len(recent) == 4 and sum(recent) / 4 > 0.4))
        for v in {p[1] for p in own if p[2]}:
            full, left = sum(p[2] for p in own if v <= p[1] < v + span), sum(p[2] for p in own if v < p[1] < v + span)
            if full >= 2 > left:
                recent = [p[3] for p in own if p[1] < v + span][-4:]
                want.append((u, "resume", v + span, None, left, False, len(recent), sum(recent), False))
    assert len(got) == len(want) and set(got) == set(want)


def test_pages_grow_with_the_stream():
    """What a page holds stays the same, however long the stream."""
    assert jobs.pages_for(1000) == 64
    assert [jobs.pages_for(n) for n in (36_000_000, 216_000_000)] == [720, 4320]
