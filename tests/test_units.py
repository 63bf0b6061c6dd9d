"""Operators on small rows whose results are known."""

import datetime as dt
import json
import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import columns
from tallyfield.operators import clean, guardrails, index, mentions, pages, series, stats
from tallyfield.sources import tables


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_mention_boundaries(spark):
    cases = [("macme", "acme", False), ("Acme!", "acme", True), ("acme_dev", "acme", True), ("acme123", "acme", False), ("I use C++ daily", "C++", True), ("ASP.NET", ".NET", False), ("use .NET now", ".NET", True), ("Café Noir", "café", True), ("cafés", "café", False), ("", "acme", False)]
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "i int, t string, a string")
    got = {r["i"]: r["hit"] for r in df.select("i", F.regexp_like("t", columns.mention_pattern("a")).alias("hit")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_find_mentions_places(spark):
    text = "-" * 50 + " Acme " + "-" * 120 + " acme"
    runs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "run_id long, raw_response string")
    entities = spark.createDataFrame([(1, "acme", "brand", ["Acme Corp"])], "entity_id long, name string, entity_type string, aliases array<string>")
    got = mentions.find_mentions(runs, entities, "raw_response", 50).orderBy("position").collect()
    assert [(r["position"], r["match"]) for r in got] == [(51, "Acme"), (177, "acme")]
    assert got[0]["context"] == text[1:105] and got[1]["context"] == text[127:]


def test_mentions_by_an_inverted_dictionary(spark, monkeypatch):
    """Against one pattern per entity, with aliases that begin with no letter, hold spaces, overlap, or have no letter at all."""
    entities = [(1, "Acme", ["acme corp", "Corp"]), (2, ".NET", ["C++", "++"]), (3, "corp c++", []), (4, "é", None), (5, "", [""]), (6, "ACME-CORP", ["a"])]
    r = random.Random(4)
    texts = ["".join(r.choice(["acme", "Acme Corp", "corp", "C++", "++", ".net", "asp", " ", " ", "_", "-", "é", "É", "\n", "a", "1", "İ"]) for _ in range(40)) for _ in range(80)] + ["", None]
    want = []
    for i, t in enumerate(texts):
        for e, name, aliases in entities:
            parts = [re.escape(x) for x in [name, *(aliases or [])] if x]
            if parts and t:
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
                found = re.finditer(rf"(?<![^\W_])({'|'.join(p.lower() for p in parts)})(?![^\W_])", low)
                want += [(i, e, k, m.start(), t[m.start() : m.end()], t[max(0, m.start() - 5) : m.end() + 5]) for k, m in enumerate(found)]
    df = spark.createDataFrame(list(enumerate(texts)), "run_id long, raw_response string").repartition(3)
    frame = spark.createDataFrame([(e, n, "brand", a) for e, n, a in entities], "entity_id long, name string, entity_type string, aliases array<string>")
    for block in (200_000, 3):
        monkeypatch.setattr(mentions, "ALIASES", block)
        got = rows(mentions.find_mentions(df, frame, "raw_response", 5), "run_id", "entity_id", "ord", "position", "match", "context")
        assert got == sorted(want, key=repr)
        counts = Counter((i, e) for i, e, *_ in want)
        assert rows(mentions.mention_counts(df, frame), "run_id", "entity_id", "n") == sorted(((i, e, n) for (i, e), n in counts.items()), key=repr)
    assert mentions.find_mentions(df, frame.limit(0), "raw_response").count() == 0


def test_share_of_voice(spark):
    df = spark.createDataFrame([("serp", 1, True, 1), ("serp", 1, False, 3), ("serp", 1, False, None), ("chat", 1, False, None), ("chat", 2, False, None)], "source string, entity_id long, is_recommendation boolean, rank int")
    assert rows(mentions.share_of_voice(df), "source", "entity_id", "mentions", "mean_rank", "share") == [("chat", 1, 1, None, 0.5), ("chat", 2, 1, None, 0.5), ("serp", 1, 3, 2.0, 1.0)]


def posts(spark, items):
    base = dt.datetime(2024, 3, 1)
    return spark.createDataFrame([("u", i, base + dt.timedelta(hours=h), removed, product) for i, (h, removed, product) in enumerate(items)], "user_id string, post_id long, posted_at timestamp, is_removed boolean, mentions_product boolean")


def test_removal_rate(spark):
    for removed, n, pause in ((2, 10, False), (3, 10, True), (3, 9, False)):
        got = guardrails.removal_rate(posts(spark, [(i, i < removed, False) for i in range(n)])).first()
        assert got["pause"] is pause


def test_promo_cap_window_edge(spark):
    got = rows(guardrails.promo_cap(posts(spark, [(0, False, True), (24, False, True), (168, False, True), (169, False, True)])), "post_id", "promos", "pause")
    assert got == [(0, 1, False), (1, 2, False), (2, 2, False), (3, 3, True)]


def test_slow_burn(spark):
    spread = guardrails.slow_burn(posts(spark, [(24 * i, i in (0, 8, 16, 24), False) for i in range(30)])).first()
    burst = guardrails.slow_burn(posts(spark, [(24 * i if i > 3 else i * 3, i < 4, False) for i in range(30)])).first()
    assert spread["alert"] is True and burst["alert"] is False


def test_karma_trend(spark):
    def status(points):
        df = spark.createDataFrame([("u", dt.datetime(2024, 3, 1) + dt.timedelta(days=d), float(x)) for d, x in points], "user_id string, taken_at timestamp, total double")
        return guardrails.karma_trend(df, F.lit("2024-03-20 00:00:00").cast("timestamp")).first()["status"]

    assert status([(10, 1000), (19, 1050)]) == "ok"
    assert status([(10, 1000), (19, 950)]) == "warning"
    assert status([(4, 1000), (19, 900)]) == "alert"
    assert status([(19, 5)]) == "ok"


def test_hedonic(spark):
    df = spark.createDataFrame([("[]",), ('["PREMIUM_UPGRADE"]',), ('["PORTION_REDUCTION","PREMIUM_UPGRADE"]',), ("not json",), (None,)], "s string")
    price, flag = columns.hedonic(F.lit(100.0), "s")
    got = [(round(r[0], 6), r[1]) for r in df.select(price, flag).collect()]
    assert got == [(100.0, False), (95.0, True), (103.0, True), (100.0, False), (100.0, False)]


def test_classify_order(spark):
    from tallyfield import params

    df = spark.createDataFrame([("Steak frites",), ("Fried Rice with egg",), ("Laksa soup",), ("plain",), (None,)], "n string")
    assert [r[0] for r in df.select(columns.classify("n", params.CATEGORY_RULES)).collect()] == ["BEVERAGE", "RICE_DISH", "NOODLE_DISH", "OTHER", "OTHER"]


def test_language(spark):
    df = spark.createDataFrame([("ข้าว rice",), ("चाय",), ("炒饭",), ("شاي",), ("Nasi goreng",), ("bread",)], "n string")
    assert [r[0] for r in df.select(columns.language("n")).collect()] == ["th", "hi", "zh", "ar", "ms", "en"]


def test_f_tail_against_published_values():
    for f, n, p in ((4.2012, 31, 0.0499), (2.3162, 10, 0.1718), (8.0434, 38, 0.0075), (9.0542, 38, 0.0048)):
        assert abs(stats.f_tail(f, 1, n - 3) - p) < 6e-5


def test_granger_finds_the_lead(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=60)
    y = np.r_[0, 0.9 * x[:-1]] + r.normal(size=60) * 0.2
    months = [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(60)]
    df = spark.createDataFrame([("lead", m, float(a), float(b)) for m, a, b in zip(months, x, y)] + [("short", months[0], 1.0, 1.0)], "country string, month date, x double, y double")
    got = {r["country"]: r for r in stats.granger(df, ["country"]).collect()}
    assert got["lead"]["significant"] and got["lead"]["p"] < 1e-6 and got["short"]["reason"].startswith("only 1")
    walk = spark.createDataFrame([("walk", m, float(v)) for m, v in zip(months, np.cumsum(np.abs(r.normal(size=60))))] + [("flat", m, float(v)) for m, v in zip(months, r.normal(size=60))], "country string, month date, v double")
    assert dict(rows(stats.stationarise(walk, ["country"]).select("country", "differenced").distinct(), "country", "differenced")) == {"walk": True, "flat": False}


def test_gaps_and_interpolation(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2020, 1, 1), 1.0), ("a", d(2020, 3, 1), 3.0), ("a", d(2020, 6, 1), 5.0)], "k string, month date, v double")
    assert rows(series.fill_single_gaps(df, ["k"], "v"), "month", "v")[1] == (d(2020, 2, 1), 2.0)
    assert len(series.fill_single_gaps(df, ["k"], "v").collect()) == 4
    assert rows(series.interpolated(df, ["k"], "v"), "month", "v")[3] == (d(2020, 4, 1), pytest.approx(3 + 2 / 3))
    q = spark.createDataFrame([("a", "2015-Q1", 1.0), ("a", "2015Q2", 4.0), ("a", "bad", 9.0)], "k string, quarter string, v double")
    assert [v for _, v in rows(series.interpolate_quarterly(q, ["k"], "v"), "month", "v")] == [1.0, 2.0, 3.0, 4.0, 4.0, 4.0]


def test_payload_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"country_code": "us", "data": [{"period": "2020-01", "cpi": 1.5}, {"period": "2020-02", "cpi": None}]}))
    assert rows(tables.read_cpi_json(spark, str(tmp_path)), "country_code", "month", "cpi") == [("us", dt.date(2020, 1, 1), 1.5)]
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "p string")
    sdmx = {"series": {"0:1": {"observations": {"0": [1.0], "1": [2.0], "2": [None]}}}, "times": ["2009-12", "2010-01", "2010-02"]}
    assert rows(tables.flatten_sdmx(one(sdmx), "p", 2010), "series", "period", "value") == [("0:1", "2010-01", 2.0)]
    labels = spark.createDataFrame([("1988 JAN", "1.5"), ("1988 XXX", "1"), ("1988 FEB", "-"), ("1988 MAR", "-2")], "l string, v string")
    assert rows(tables.parse_month_label(labels, "l", "v"), "month", "value") == [(dt.date(1988, 1, 1), 1.5)]
    pair = [{"page": 1}, [{"country": {"id": "SG"}, "date": "2019", "value": 3.0}, {"country": {"id": "SG"}, "date": "2020", "value": None}]]
    assert rows(tables.flatten_pair_payload(one(pair), "p"), "key", "month", "value") == [("SG", dt.date(2019, 1, 1), 3.0)]
    assert rows(tables.decode_keyed_content(one({"x202001": 1.0, "y202001": 3.0, "z": 5.0}), "p"), "month", "value") == [(dt.date(2020, 1, 1), 2.0)]
    now = dt.datetime(2024, 1, 2)
    snaps = spark.createDataFrame([("A", 1.0, "constant", None), ("A", 2.0, "cache", now - dt.timedelta(hours=30)), ("A", 3.0, "fetched", now), ("B", 4.0, "cache", now - dt.timedelta(hours=3)), ("B", 5.0, "fetched", now), ("C", 6.0, "constant", None)], "currency string, rate double, kind string, at timestamp")
    assert rows(tables.resolve_rates(snaps, F.lit(now)), "currency", "rate") == [("A", 3.0), ("B", 4.0), ("C", 6.0)]


PAGE = """<html><title>Menu of The Lantern</title><script type="application/ld+json">{"@type":"Menu","hasMenuItem":[{"@type":"MenuItem","name":"Soup","offers":{"price":"4.50","priceCurrency":"USD"}},
{"@type":"MenuItem","name":"Tea","price_in_cents":250,"currency":"USD"},{"@type":"Organization","name":"Org","price":1},{"name":"Dear","price":"1e9"}]}</script>
<script id="__NEXT_DATA__">{"items":[{"name":"Bun","priceInMinorUnit":300,"priceCurrency":"SGD","below":{"name":"not seen","price":1}},{"name":"Bun","price":3.001,"priceCurrency":"SGD"},{"title":"no name","price":2}]}</script><p>Pho $12.50 and S$8</p><table><tr><td>US</td><td>5.1</td></tr><tr><th>x</th></tr></table> 1,200 for two
{"name":"Nasi \\u0041","id":1,"raw_price":"12.5"}</html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<script type='application/ld+json'>{broken</script>")], "page_id long, html string")
    assert rows(pages.extract_items(df, "jsonld"), "page_id", "name", "price", "currency") == [(1, "Dear", 19.0, None), (1, "Org", 1.0, None), (1, "Soup", 4.5, "USD")]
    assert rows(pages.extract_items(df, "nextdata"), "name", "price") == [("Bun", 3.0)]
    assert rows(pages.extract_items(df, "raw_price"), "name", "price") == [("Nasi A", 12.5)]
    assert rows(pages.price_tokens(df, {"USD": r"(?<![A-Z])\$\s?([0-9.]+)", "SGD": r"S\$\s?([0-9.]+)"}), "currency", "tokens", "values") == [("SGD", 1, [8.0]), ("USD", 1, [12.5])]
    assert df.where("page_id = 1").select(pages.cost_for_two("html")).first()[0] == 1200.0
    assert rows(pages.table_rows(df), "name", "value") == [("US", 5.1)]
    assert dict(rows(pages.node_types(df), "type", "nodes")) == {"Menu": 1, "MenuItem": 2, "Organization": 1}
    assert rows(pages.priced_nodes(df), "page_id", "typed", "generic") == [(1, 1, 3)]  # an offer stands in a node that has a name


def test_structure_counts(spark):
    tree = {"@type": ["Menu", "Thing"], "name": "M", "x": [{"@type": "Offer", "price": "$8.99"}, {"priceInCents": 250, "amount": 90}, {"@type": "Odd", "price": "none", "unitPrice": 0}], "o": {"title": "t", "sub": {"price": 3}}}
    lone = [{"price": 5}, {"displayName": " ", "listPrice": 2}, 7, None, [[{"name": "deep", "@type": "Product", "listPrice": "1,250 USD"}]]]
    df = spark.createDataFrame([(i, f"<script type=application/ld+json>{json.dumps(t)}</script>") for i, t in enumerate((tree, lone))], "page_id long, html string")
    assert rows(pages.priced_nodes(df), "page_id", "typed", "generic") == [(0, 1, 4), (1, 1, 1)]
    assert rows(pages.node_types(df), "page_id", "type", "nodes") == [(0, "Menu", 1), (0, "Odd", 1), (0, "Offer", 1), (0, "Thing", 1), (1, "Product", 1)]


def test_generic_prices(spark):
    cases = [
        ({"name": "a", "price": "12.99"}, [("a", 12.99)]), ({"itemName": "b", "price": {"amount": 1299, "currency": "USD"}}, [("b", 12.99)]), ({"title": "c", "prices": {"cents": 1250, "points": 0}}, [("c", 12.5)]),
        ({"name": "", "title": "d", "basePrice": 1001}, [("d", 10.01)]), ({"name": "e", "price": 0, "finalPrice": {"value": "7"}}, [("e", 7.0)]), ({"name": "f", "price": {"cents": None, "amount": 5}}, []), ({"name": "g", "price": [1]}, []),
        ({"name": "h", "prices": {"amount": 500, "currency": "USD"}}, [("h", 500.0)]), ({"x": {"name": "i", "defaultPrice": {"pence": 99}}, "name": "j", "price": 2}, [("j", 2.0), ("i", 0.99)]), ([{"name": "k", "price": "x"}, {"name": "l" * 300, "price": 1}], [("l" * 200, 1.0)]),
    ]
    deep = {"name": "at", "price": 1}
    for _ in range(15):
        deep = {"x": deep}
    cases += [({"x": deep}, [("at", 1.0)]), ({"x": {"x": deep}}, [])]  # sixteen and seventeen containers down
    df = spark.createDataFrame([(i, f"<script type='application/json'>{json.dumps(c)}</script>") for i, (c, _) in enumerate(cases)], "page_id long, html string")
    got = pages.any_items(df, "USD").orderBy("page_id", "ord").collect()
    assert [[(r["name"], r["price"]) for r in got if r["page_id"] == i] for i in range(len(cases))] == [w for _, w in cases]
    many = json.dumps([{"name": f"n{i}", "price": 1 + i % 900} for i in range(12_000)])
    assert pages.any_items(spark.createDataFrame([(1, f"<script type='application/json'>{many}</script>")], "page_id long, html string"), "USD").count() == 12_000


def test_prices_in_context(spark):
    text = "Pad Thai only 120 baht " + "x" * 200 + " 80 baht, noodle soup 60 baht; NOODLE  soup 60 baht and 5 baht " + "y" * 100 + " 99 baht"
    many = " ".join(f"rice {i} baht" for i in range(20, 40))
    df = spark.createDataFrame([(1, text), (2, None), (3, many), (4, "İ rice 30 baht")], "page_id long, text string")
    got = pages.context_items(df, [r"(\d+) baht"], ["soup", "pad thai", "rice"], before=20, after=10)
    assert [tuple(r) for r in got.where("page_id = 1").orderBy("ord").collect()] == [(1, 0, "Pad Thai only 120 ba", 120.0), (1, 1, "noodle soup 60 baht; NO", 60.0), (1, 2, "NOODLE soup 60 baht and", 60.0)]
    assert [(r["ord"], r["price"]) for r in got.where("page_id = 3").orderBy("ord").collect()] == [(i, 20.0 + i) for i in range(6)] and got.where("page_id = 4").count() == 1


def test_price_labels(spark):
    df = spark.createDataFrame([("Rp 25.000",), ("S$4.50",), ("RM12",), ("$1,299.00",), ("free",)], "t string")
    assert [(r[0]["price"], r[0]["currency"]) if r[0] else None for r in df.select(pages.parse_price_label("t")).collect()] == [(25000.0, "IDR"), (4.5, "SGD"), (12.0, "MYR"), (1299.0, "USD"), None]


def test_symbols_and_backfill(spark):
    df = spark.createDataFrame([("S$", "Singapore", 1.35), ("?", "Thailand", 36.0), ("$", "Thailand", 2.0), (None, "Nowhere", 1.0)], "currency_symbol string, country string, price_local double")
    got = clean.usd_from_symbol(df, [("S$", "SGD"), ("$", "USD")], {"Thailand": "THB"})
    assert [r["price_usd"] for r in got.collect()] == [1.0, 1.0, 2.0, None]


def test_label_responses(spark):
    df = spark.createDataFrame([('{"score": 130}',), ('{"score": 12}',), ("junk",)], "r string")
    assert rows(guardrails.parse_scores(df, "r"), "score") == [(100.0,)]


def test_index_one_sided_sector(spark):
    df = spark.createDataFrame([("X", "r", "formal", dt.date(2020, 1, 1), 2.0), ("X", "r", "formal", dt.date(2020, 2, 1), 3.0), ("X", "s", "informal", dt.date(2020, 2, 1), 5.0)], "country string, restaurant_name string, sector string, month date, price_usd double")
    got = rows(index.restaurant_median_index(df, F.lit(0.4)), "month", "formal_index", "informal_index", "combined_index")
    assert got == [(dt.date(2020, 1, 1), 100.0, None, 100.0), (dt.date(2020, 2, 1), pytest.approx(150.0), 100.0, pytest.approx(130.0))]


def test_the_index_queries_keep_three_hundred_rows_a_country_and_month(spark):
    from tallyfield.catalog.base import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    n = t.cleaned.groupBy("country", "month").count()
    want = n.agg(F.sum(F.least("count", F.lit(300)))).first()[0]
    assert n.where("count > 20").count() and t.capped.count() == want
    few = spark.createDataFrame([(f"k{i}", "A" if i < 50 else "B") for i in range(60)], "k string, g string")
    assert {r["g"]: r["count"] for r in clean.cap_rows(few, ["g"], 20, "42", "k").groupBy("g").count().collect()} == {"A": 20, "B": 10}


def test_the_union_query_gives_the_operators_own_pass(spark, monkeypatch):
    from tallyfield import catalog

    real = mentions.union_first
    monkeypatch.setattr(mentions, "union_first", lambda dfs, key: real(dfs, key).withColumn("pass", F.col("pass") + 10))
    assert {r["pass"] for r in catalog.queries()["union_first"](spark, "/root/testdata/sf0.001").collect()} == {10, 11}


def test_within_range(spark):
    at = lambda h: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
    events = spark.createDataFrame([("u", i, at(h)) for i, h in enumerate((0, 24, 48, 72, -1000))] + [("v", 9, at(0)), (None, 10, at(0)), ("u", 11, None)], "k string, e long, t timestamp")
    refs = spark.createDataFrame([("u", "a", at(24)), ("u", "b", at(48)), ("u", "c", at(71.999)), ("v", "d", at(24)), ("w", "e", at(0)), (None, "f", at(0)), ("u", "g", None)], "k string, r string, at timestamp")
    got = clean.within_range(events, refs, ["k"], "t", "at", 86400)
    assert rows(got, "r", "e") == [("a", 1), ("b", 2), ("c", 2)]  # a day before the reference is out, its own moment in
    assert not re.search("Cartesian|NestedLoop", got._jdf.queryExecution().toString())


def test_rate_versions(spark):
    at = lambda h: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
    snaps = spark.createDataFrame([("A", 1.0, "constant", None), ("A", 2.0, "cache", at(0)), ("A", 3.0, "fetched", at(10)), ("A", 4.0, "cache", at(100)), ("A", 5.0, "cache", at(100)), ("B", 6.0, "cache", at(5)), ("C", 7.0, "constant", None), (None, 1.0, "constant", None)], "currency string, rate double, kind string, at timestamp")
    asked = [("A", -1, 1.0), ("A", 0, 2.0), ("A", 23.9, 2.0), ("A", 24, 3.0), ("A", 99, 3.0), ("A", 101, 4.0), ("A", 124, 3.0), ("A", 9000, 3.0), ("B", 4, None), ("B", 5, 6.0), ("B", 5000, 6.0), ("C", 0, 7.0), ("D", 0, None)]
    df = spark.createDataFrame([(c, at(h), i) for i, (c, h, _) in enumerate(asked)], "currency string, t timestamp, i int")
    got = {r["i"]: r["rate"] for r in tables.rates_as_of(df, tables.rate_versions(snaps), "t").collect()}
    assert [got[i] for i in range(len(asked))] == [w for _, _, w in asked]
    assert tables.rates_as_of(df.where("i < 0"), tables.rate_versions(snaps), "t").count() == 0


def test_erasure_comes_into_force_at_once(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tallyfield-users-")
    registry = {"posts": guardrails.UserTable(), "users": guardrails.UserTable("id", True, ("mail",))}
    posts = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "c"), (None, "d")], "user_id string, text string")
    users = spark.createDataFrame([(1, "m1"), (2, "m2"), (None, "m3")], "id long, mail string")
    guardrails.publish(spark, root, {"posts": posts, "users": users, "other": users.limit(1)})
    asked = spark.createDataFrame([("r1", "1"), ("r1", "1"), ("r9", "9"), (None, "2")], "request_id string, user_id string")
    with monkeypatch.context() as m:  # a job that ends before the rename
        m.setattr(guardrails, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            guardrails.erase_users(spark, root, registry, asked)
    assert guardrails.current(spark, root, "posts").count() == 4
    for _ in range(2):
        assert guardrails.erase_users(spark, root, registry, asked) == 2
        assert rows(guardrails.current(spark, root, "posts"), "user_id", "text") == [("2", "b"), (None, "d")]
        assert rows(guardrails.current(spark, root, "users"), "id", "mail") == [(2, "m2"), (None, "m3"), (None, None)]
        assert rows(guardrails.current(spark, root, "audit"), "request_id", "n_posts", "n_users") == [("r1", 2, 1), ("r9", 0, 0)]
        assert guardrails.current(spark, root, "other").count() == 1
    more = spark.createDataFrame([("r2", "2"), ("r1", "2")], "request_id string, user_id string")
    assert guardrails.erase_users(spark, root, registry, more) == 3
    assert rows(guardrails.current(spark, root, "audit"), "request_id", "n_posts") == [("r1", 2), ("r2", 1), ("r9", 0)]
    bundle = guardrails.export_bundle({"posts": posts}, {"posts": registry["posts"]}, spark.createDataFrame([("1",), ("7",), ("1",), (None,)], "user_id string"))
    assert rows(bundle, "user_id", "n", "rows") == [("1", 2, '[{"text":"a","user_id":"1"},{"text":"c","user_id":"1"}]'), ("7", 0, "[]")]


def test_pages_of_parts_are_dealt_to_tasks(spark, monkeypatch):
    """A part's page is put together in as many tasks as there are pages for, whatever the file's splits."""
    from pyspark.sql import functions as F

    from tallyfield.catalog import base
    from tallyfield.catalog import pages as queries

    monkeypatch.setattr(queries, "PAGES", 20)
    t = base.Tables(spark, "/root/testdata/sf0.001")
    made = queries._shop(t, F.lit("x"))
    assert made.rdd.getNumPartitions() == -(-t.read("part").count() // 20) > 2 and made.count() == t.read("part").count()
