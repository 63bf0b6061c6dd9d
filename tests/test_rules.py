"""Rules and models on small fixtures: values from the specification, not from the library's own SQL."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyfield.operators import clean, community, guardrails, labels, pages, quality, series, serving, stats


def tail_by_integration(f, d1, d2):
    """P(F > f) by numbers: the density of the beta variable, summed."""
    x = d2 / (d2 + d1 * f)
    u = (np.arange(400_000) + 0.5) / 400_000 * x
    log = (d2 / 2 - 1) * np.log(u) + (d1 / 2 - 1) * np.log1p(-u)
    beta = math.lgamma(d1 / 2) + math.lgamma(d2 / 2) - math.lgamma((d1 + d2) / 2)
    return float(np.exp(log - beta).mean() * x)


@pytest.mark.parametrize("f,d1,d2", [(4.2012, 1, 28), (2.5, 3, 17), (0.4, 2, 9), (9.05, 4, 60)])
def test_f_tail(f, d1, d2):
    assert abs(stats.f_tail(f, d1, d2) - tail_by_integration(f, d1, d2)) < 2e-5


def test_t_quantile():
    assert abs(stats.t_quantile(0.05, 10) - 2.228139) < 1e-5 and abs(stats.t_quantile(0.05, 28) - 2.048407) < 1e-5


def months(n):
    return [date(2010 + i // 12, i % 12 + 1, 1) for i in range(n)]


def frame(spark, n, seed, lead=0.6):
    r = np.random.default_rng(seed)
    x = 100 + np.cumsum(r.normal(0, 1, n))
    y = 100 + np.cumsum(np.r_[0, 0, lead * np.diff(x)[:-1]] + r.normal(0, 0.5, n))
    rows = pd.DataFrame({"country": "A", "month": months(n), "x": x, "y": y})
    return rows, spark.createDataFrame(rows)


@pytest.mark.parametrize("n", [15, 60])
def test_pass_through_models_against_normal_equations(spark, n):
    rows, df = frame(spark, n, 3)
    got = stats.pass_through_models(df, ["country"]).collect()[0]
    dy, dx = np.diff(np.log(rows.y)), np.diff(np.log(rows.x))
    if n < 21:
        design, y = [[1.0, a] for a in dx], list(dy)
    else:
        design, y = [], []
        for t in range(2, len(dy)):
            m = rows.month[t + 1].month
            design.append([1.0, dx[t], dy[t - 1], dx[t - 1], dy[t - 2], dx[t - 2], *(float(m == k) for k in range(2, 13))])
            y.append(dy[t])
    design, y = np.array(design), np.array(y)
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    rest = len(y) - design.shape[1]
    rss = ((y - design @ beta) ** 2).sum()
    se = math.sqrt(rss / rest * inverse[1, 1])
    assert (got["lags"], got["n"], got["reason"]) == (0 if n < 21 else 2, n - 1, None)
    assert np.allclose([got["beta"], got["se"], got["r2"]], [beta[1], se, 1 - rss / ((y - y.mean()) ** 2).sum()], rtol=1e-6)
    assert abs(got["p"] - tail_by_integration((beta[1] / se) ** 2, 1, rest)) < 2e-3 and got["ci_low"] < got["beta"] < got["ci_high"]
    assert stats.pass_through_models(df.limit(3), ["country"]).first()["reason"]


def f_by_loops(y, x, k):
    """F and its freedom for k lags, by normal equations over rows put together one by one."""
    own = np.array([[1.0, *(y[t - j] for j in range(1, k + 1))] for t in range(k, len(y))])
    full = np.array([[*o, *(x[t - j] for j in range(1, k + 1))] for o, t in zip(own, range(k, len(y)), strict=True)])
    rss = lambda a: float(((y[k:] - a @ np.linalg.solve(a.T @ a, a.T @ y[k:])) ** 2).sum())
    rest = len(own) - full.shape[1]
    return (rss(own) - rss(full)) / k / (rss(full) / rest), rest


def test_granger_models_against_loops(spark):
    rows, df = frame(spark, 60, 5)
    x, y = rows.x.to_numpy(), rows.y.to_numpy()
    got = stats.granger(df, ["country"]).first()
    f, rest = f_by_loops(y, x, got["best_lag"])
    assert abs(got["f"] - f) < 1e-6 * f and abs(got["p"] - tail_by_integration(f, got["best_lag"], rest)) < 2e-3
    robust = stats.granger_robust(df, ["country"]).first()
    tests = {k: f_by_loops(np.diff(y), np.diff(x), k) for k in (1, 2, 3)}
    p = {k: tail_by_integration(f, k, rest) for k, (f, rest) in tests.items()}
    assert robust["lead_months"] == min(p, key=p.get) and abs(robust["p"] - min(p.values())) < 2e-3 and robust["significant"]
    assert not stats.granger_robust(df.limit(6), ["country"]).first()["significant"]


def test_stationarise_tells_walks_from_noise(spark):
    r = np.random.default_rng(12)
    rows = [("walk", m, float(v)) for m, v in zip(months(150), np.cumsum(r.normal(size=150)), strict=True)] + [("noise", m, float(v)) for m, v in zip(months(150), r.normal(size=150), strict=True)]
    out = stats.stationarise(spark.createDataFrame(rows, "country string, month date, v double"), ["country"]).groupBy("country", "differenced").count().collect()
    assert {(x["country"], x["differenced"], x["count"]) for x in out} == {("walk", True, 149), ("noise", False, 150)}


def test_sector_split(spark):
    rows = spark.createDataFrame([("formal", 0.2), ("formal", 0.4), ("informal", None)], "sector string, p double")
    assert tuple(stats.sector_split(rows).first()) == (0.30000000000000004, 1.0, 0, 0, "formal")


def test_rules_of_sources_and_series(spark):
    caps = spark.createDataFrame([(h, datetime(2010 + i % years, 1, 1), 4000) for h, n, years in (("a", 50, 3), ("b", 49, 3), ("c", 20, 2), ("d", 19, 2), ("e", 60, 1)) for i in range(n)], "host string, at timestamp, length int")
    assert {r["host"]: r["verdict"] for r in pages.source_verdict(caps, ["host"]).collect()} == {"a": "usable", "b": "marginal", "c": "marginal", "d": "drop", "e": "drop"}
    rows = [("full", m) for m in months(24)] + [("short", m) for m in months(11)] + [("thin", m) for m in months(36)[::2]]
    got = series.frequency(spark.createDataFrame(rows, "country string, month date"), ["country"]).collect()
    assert {r["country"]: r["frequency"] for r in got} == {"full": "monthly", "short": "annual", "thin": "annual"}


def test_rules_of_brands_and_karma(spark):
    got = guardrails.alias_variants(spark.createDataFrame([(" Big Mac Co ",), ("",)], "name string")).collect()
    assert sorted(got[0]["variants"]) == sorted({"Big Mac Co", "big mac co", "BigMacCo", "bigmacco", "bigmacco.com", "bigmacco.io"}) and got[1]["variants"] == []
    now = datetime(2024, 1, 31)
    snaps = [(u, now - timedelta(days=d), v) for u, rows in {"held": [(20, 100), (8, 30), (0, 30)], "both": [(20, 100), (8, 100), (0, 20)], "week": [(20, 10), (8, 100), (0, 20)], "new": [(0, 5)]}.items() for d, v in rows]
    out = guardrails.karma_trend(spark.createDataFrame(snaps, "user_id string, taken_at timestamp, total long"), F.lit(now)).collect()
    assert {r["user_id"]: r["status"] for r in out} == {"held": "ok", "both": "alert", "week": "warning", "new": "ok"}


def test_price_labels_and_items(spark):
    text = spark.createDataFrame([("A$ 12.50",), ("S$3",), ("US 4",), ("USD 4",), ("$5",), ("Rp 25.000",)], "t string")
    assert [r[0] and (r[0]["price"], r[0]["currency"]) for r in text.select(pages.parse_price_label("t")).collect()] == [(12.5, "AUD"), (3.0, "SGD"), None, (4.0, "USD"), (5.0, "USD"), (25000.0, "IDR")]
    assert {"Restaurant", "FoodEstablishment", "LocalBusiness", "Place", "GeoCoordinates"} <= set(pages.NOT_ITEMS)
    alert = quality.failure_alert(spark.createDataFrame([("a", True), ("a", False), ("b", False)], "k string, bad boolean"), "k", "bad").collect()
    assert {r["k"]: r["alert"] for r in alert} == {"a": True, "b": False}


def test_asof_previous_is_strictly_earlier(spark):
    history = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 6.0), ("a", 3, 7.0), ("b", 9, 1.0)], "k string, t int, v double")
    now = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("a", 1, "z"), ("b", 2, "w"), ("c", 1, "n")], "k string, t int, note string")
    got = {r["note"]: (r["previous_v"], r["previous_t"]) for r in clean.asof_previous(now, history, ["k"], "t", "v").collect()}
    assert got == {"x": (5.0, 1), "y": (7.0, 3), "z": (None, None), "w": (None, None), "n": (None, None)}


def test_labels(spark):
    names = ["Iced Tea", "tea cake", "tea leaf salad", "rice noodle", "Fried Rice", "Set A", "new! rice", "???", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(labels.reference_label("n")).collect()]
    assert got == ["BEVERAGE", "DESSERT", "SALAD_VEGETABLE", "NOODLE_DISH", "RICE_DISH", "SET_MEAL", "OTHER", "OTHER", "OTHER"]
    replies = ['```json\n[{"item": "b", "category": "FAST_FOOD", "confidence": 2}, {"item": "a ", "category": "?", "quality_signals": ["x"]}]\n```', "not json", '[{"item": "a", "confidence": "NaN", "language_detected": ""}]']
    rows = spark.createDataFrame([(i, ["a ", "b"], r) for i, r in enumerate(replies)], "batch_id int, items array<string>, reply string")
    out = {(r["batch_id"], r["place"]): (r["item"], r["category"], r["confidence"], r["language_detected"], r["quality_signals"]) for r in labels.parse_label_response(rows).collect()}
    assert out[0, 0] == ("a ", "OTHER", 0.5, "en", []) and out[0, 1] == ("b", "FAST_FOOD", 1.0, "en", [])
    assert out[1, 0] == ("a ", "OTHER", 0.5, "en", []) and out[2, 0] == ("a", "OTHER", 0.5, "en", []) and len(out) == 6


def test_gates(spark):
    posts = spark.createDataFrame([(0, "I work for Acme", ["acme"], False), (1, "Acme employee here", ["acme"], None), (2, "nothing", [], True), (3, "acme team", [], True), (4, "plain", None, None)], "id int, body string, found array<string>, said boolean")
    got = {r["id"]: (r["mentions_product"], r["accepted_phrases"], r["verdict"]) for r in community.disclosure_gate(posts, "body", "found", "said", ["Acme"]).collect()}
    assert got == {0: (True, ["i work for"], "ok"), 1: (True, ["acme employee"], "ok"), 2: (True, [], "disclosure_required"), 3: (True, ["acme team"], "ok"), 4: (False, [], "ok")}
    f = spark.createDataFrame
    requests = f([("p", 1), ("u", 9), ("u", 1), ("u", 2), ("u", 3), ("v", 3)], "user_id string, opportunity_id int")
    out = community.eligibility(
        requests, f([("p", True), ("u", False), ("v", False)], "user_id string, is_paused boolean"), f([(1, "s1"), (2, "s2"), (3, "s3")], "opportunity_id int, subreddit string"),
        f([("u", "s2", False), ("u", "s3", True), ("v", "s3", True), ("p", "s1", True)], "user_id string, subreddit string, matches_expertise boolean"), f([("v", 3), ("u", 2)], "user_id string, promos int"),
    )
    assert {(r["user_id"], r["opportunity_id"]): r["reason"] for r in out.collect()} == {("p", 1): "paused", ("u", 9): "no_opportunity", ("u", 1): "not_preexisting_active", ("u", 2): "not_expertise_match", ("u", 3): "ok", ("v", 3): "weekly_promo_cap"}


def test_drafts_and_histogram(spark):
    steps = [(1, i, s) for i, s in enumerate(["draft", "edited", "published", "edited"])] + [(2, 0, "edited")]
    got = community.draft_transitions(spark.createDataFrame(steps, "d int, at int, s string"), "d", "s", "at", "at").orderBy("d", "at").collect()
    assert [r["legal"] for r in got] == [True, True, True, False, False]
    rows = spark.createDataFrame([(60,), (61,), (90_000,), (None,)], "s int")
    assert {r["le"]: r["n"] for r in community.latency_histogram(rows, F.col("s")).collect()} == {"60": 1, "300": 2, "900": 2, "3600": 2, "14400": 2, "86400": 2, "+Inf": 3}


def test_latest_values(spark):
    m = months(26)
    index = spark.createDataFrame([("A", m[12], 100.0, None), ("A", m[24], 150.0, None), ("A", m[25], None, None), ("B", m[12], 100.0, "mean-price fallback (x)"), ("B", m[24], 150.0, None)], "country string, month date, combined_index double, coverage_note string")
    index = index.withColumns({"formal_index": F.col("combined_index"), "informal_index": F.col("combined_index")})
    cpi = spark.createDataFrame([("A", m[3], 7.0)], "country string, month date, cpi double")
    counts = spark.createDataFrame([("A", 3, 4)], "country string, formal_items long, informal_items long")
    got = {r["country"]: (r["month"], r["yoy_change_pct"], r["cpi"], r["formal_items"]) for r in serving.latest_values(index, cpi, counts).collect()}
    assert got == {"A": (m[24], 50.0, 7.0, 3), "B": (m[24], None, None, 0)}
