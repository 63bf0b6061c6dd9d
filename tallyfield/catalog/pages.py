"""Queries over pages: urls, text, health and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.columns import language, stripped_html
from tallyfield.operators import pages

from .base import Tables, query

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_CAP = f"with cap as (select {_HOST} as host, regexp_extract(url, '\\.([a-z]+)(?:[/:?#]|$)', 1) as platform, regexp_replace(url, '[?#].*$', '') as url, length(html) as length, timestamp '2020-01-01' + to_days(cast(page_id * 7 % 1500 as integer)) as at_time from pages) "


def captures(t: Tables) -> DataFrame:
    p = t.read("pages")
    at = F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(cast(page_id * 7 % 1500 as int))")
    return p.select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("host"), F.regexp_extract("url", "\\.([a-z]+)(?:[/:?#]|$)", 1).alias("platform"), F.regexp_replace("url", "[?#].*$", "").alias("url"), F.length("html").cast("long").alias("length"), at.alias("at"))


@query("strip_html", "select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as text from pages")
def _(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", stripped_html("html").alias("text"))


@query("detect_language", "select doc_id, case when len(list_intersect(string_split_regex(lower(text), '\\s+'), ['nasi', 'mee', 'ayam', 'ikan', 'teh', 'kopi', 'roti', 'goreng'])) > 0 then 'ms' else 'en' end as language from documents")
def _(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", language("text").alias("language"))


@query("name_from_url", "select page_id, left(trim(replace(regexp_replace(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '' and lower(p) not in ('menu', 'order', 'delivery', 'restaurant', 'store'))[-1], '\\.html?$', ''), '-', ' ')), 80) || ' (web)' as name from pages")
def _(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", pages.name_from_url("url", "web").alias("name"))


@query("page_health", "select page_id, case when regexp_matches(lower(html), 'captcha|access denied|are you a robot') then 'blocked' when regexp_matches(lower(html), '404 not found|page not found|no longer available') then 'dead' when len(list_distinct(regexp_extract_all(html, '[$£€]\\s?[0-9]+(?:\\.[0-9]{2})?'))) >= 3 then 'menu' when contains(regexp_extract(lower(html), '(?s)<title>(.*?)</title>', 1), 'the') then 'match' else 'other' end as health from pages")
def _(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", pages.page_health("html", F.array(F.lit("the"))).alias("health"))


@query("redirected_to_listing", f"""with u as (select page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') as asked, {_HOST} as host, url from pages),
f as (select host, list_filter(string_split(regexp_extract(min(row(length(url), url))[2], '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') as final from u group by host)
select page_id, len(final) < len(asked) and (len(final) = 0 or asked[1:len(final)] = final) as listing from u join f using (host)""")
def _(t: Tables) -> DataFrame:
    """Pages as if each had ended at the shortest url of its host."""
    p = t.read("pages").select("page_id", "url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("host"))
    final = p.groupBy("host").agg(F.min(F.struct(F.length("url").alias("n"), "url"))["url"].alias("final"))
    return p.join(final, "host").select("page_id", pages.redirected_to_listing("url", "final").alias("listing"))


@query("yield_report", f"""with p as (select {_HOST} as host, lower(html) as low, p_partkey is not null and p_size % 3 <> 0 as has, page_id from pages left join part on p_partkey = page_id),
o as (select host, case when low is null or low = '' then 'no_page' when has then 'hit' when regexp_matches(low, 'captcha|access denied|are you a robot') then 'blocked' when regexp_matches(low, '404 not found|page not found|no longer available') then 'dead' when page_id % 4 <> 0 and not regexp_matches(low, '<script[^>]*json') then 'no_data' else 'no_items' end as outcome, case when has then 2 else 0 end as n from p),
k as (select host, outcome, count(*) as k from o where outcome <> 'hit' group by host, outcome), c as (select *, row_number() over (partition by host order by k desc, outcome) as place from k)
select o.host, count(*) as attempts, count(*) filter (outcome = 'hit') as hits, round(avg(n) filter (outcome = 'hit'), 4) as mean_items, cast(max(n) as bigint) as best, coalesce(any_value(top), '') as top_reasons from o left join (select host, string_agg(outcome || ': ' || k, ', ' order by place) as top from c where place <= 2 group by host) r on r.host = o.host group by o.host""")
def _(t: Tables) -> DataFrame:
    """Pages with a JSON block behind them: of two items, of none (every fourth page) or no block at all."""
    p = t.read("pages").join(t.read("part").select(F.col("p_partkey").alias("page_id"), "p_name", "p_size", "p_retailprice"), "page_id", "left")
    item = lambda n, k: F.struct(n.alias("name"), (F.round("p_retailprice", 2) + k).alias("price"))
    block = F.when(F.col("p_size") % 3 != 0, F.to_json(F.struct(F.array(item(F.col("p_name"), 0), item(F.concat("p_name", F.lit(" large")), 1)).alias("items")))).when(F.col("page_id") % 4 == 0, "{}")
    p = p.withColumn("host", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1))).withColumn("html", F.concat("html", F.coalesce(F.concat(F.lit('<script type="application/json">'), block, F.lit("</script>")), F.lit(""))))
    return pages.yield_report(pages.any_items(p), p, "host")


@query("distributed_sample", _CAP + ", f as (select * from cap qualify row_number() over (partition by platform, url order by at_time, length) = 1), q as (select *, date_trunc('quarter', at_time) as period from f qualify row_number() over (partition by platform, date_trunc('quarter', at_time) order by at_time, url) <= 3) select platform, url, strftime(at_time, '%Y-%m-%d') as day from q qualify row_number() over (partition by platform order by at_time, url) <= 25")
def _(t: Tables) -> DataFrame:
    return pages.distributed_sample(captures(t), ["platform"], "quarter", 3, 25).select("platform", "url", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("capture_coverage", _CAP + ", b as (select platform, url, count(*) as n, min(at_time) as a, max(at_time) as z from cap group by all) select platform, cast(sum(n) as bigint) as snapshots, count(*) as distinct_urls, count(*) filter (n >= 2) as repeated_urls, strftime(min(a), '%Y-%m-%d') as earliest, strftime(max(z), '%Y-%m-%d') as latest, sum(n) >= 80 as truncated from b group by all")
def _(t: Tables) -> DataFrame:
    c = pages.capture_coverage(captures(t), ["platform"], 80)
    return c.withColumns({x: F.date_format(x, "yyyy-MM-dd") for x in ("earliest", "latest")})


@query("source_verdict", _CAP + ", v as (select host, count(*) filter (length > 3000) as pages, count(distinct extract(year from at_time)) as years from cap group by all) select *, case when pages >= 50 and years >= 3 then 'usable' when pages >= 20 and years >= 2 then 'marginal' else 'drop' end as verdict from v")
def _(t: Tables) -> DataFrame:
    return pages.source_verdict(captures(t), ["host"])


@query("best_platform", _CAP + ", b as (select extract(year from at_time) as year, platform, count(distinct url) as distinct_urls from cap group by all) select cast(year as integer) as year, platform, distinct_urls, distinct_urls >= 15 as passes from b qualify row_number() over (partition by year order by distinct_urls desc, platform desc) = 1")
def _(t: Tables) -> DataFrame:
    c = pages.capture_coverage(captures(t).withColumn("year", F.year("at")), ["year", "platform"], 1000)
    return pages.best_platform(c, "year", "platform", 15)


@query("sample_without_junk", _CAP + ", j as (select *, count(*) filter (regexp_matches(lower(url), '/de/|html')) over (partition by host) as junk from cap) select host, url, junk from j where not regexp_matches(lower(url), '/de/|html') qualify row_number() over (partition by host order by at_time, url) <= 2")
def _(t: Tables) -> DataFrame:
    return pages.sample_without_junk(captures(t), "host", ["/de/", "html"], 2).select("host", "url", "junk")


@query("largest_capture", _CAP + ", s as (select *, url as store from cap) select store, max(length) as length from s where store not like '%/de/%' group by all")
def _(t: Tables) -> DataFrame:
    from tallyfield.operators.clean import largest_capture

    have = captures(t).where("url like '%/de/%'").select(F.col("url").alias("store"))
    return largest_capture(captures(t), have).select("store", "length")


@query("audit_summary", f"select platform, count(*) filter (v = 'large') as large, count(*) filter (v = 'small') as small from (select platform, case when length > 3000 then 'large' else 'small' end as v from ({_CAP} select * from cap)) group by all")
def _(t: Tables) -> DataFrame:
    c = captures(t).withColumn("v", F.when(F.col("length") > 3000, "large").otherwise("small"))
    return c.groupBy("platform").pivot("v", ["large", "small"]).count().fillna(0)


# item extraction, over pages that are put together from the parts


#: Pages that a task puts together and takes apart.
PAGES = 5000


def _shop(t: Tables, body) -> DataFrame:
    """A page per part: (page_id, html), PAGES a task. A part is a few bytes of its file and its page a walk of many objects: by the file's splits, a task or two would do them all."""
    part = t.read("part")
    return part.repartition(max(1, -(-part.count() // PAGES)), "p_partkey").select(F.col("p_partkey").alias("page_id"), body.alias("html"))


_NAME = "p_name || ' ' || p_partkey"
_COST = "cast(round(p_retailprice, 2) as double)"


def _text():
    return F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), F.round("p_retailprice", 2).cast("double")


@query("extract_menuitem", f"select p_partkey as page_id, 0 as ord, {_NAME} as name, {_COST} as price from part where p_partkey % 3 <> 0 union all select p_partkey, 1, 'side', 2.5 from part where p_partkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    name, price = _text()
    item = F.struct(F.when(F.col("p_partkey") % 3 == 0, "Place").otherwise("MenuItem").alias("@type"), name.alias("name"), F.struct(price.alias("price")).alias("offers"))
    side = F.struct(F.when(F.col("p_partkey") % 2 == 0, "MenuItem").otherwise("Thing").alias("@type"), F.lit("side").alias("name"), F.struct(F.lit(2.5).alias("price")).alias("offers"))
    menu = F.to_json(F.struct(F.lit("Restaurant").alias("@type"), F.struct(F.array(item, side).alias("hasMenuItem")).alias("menu")))
    out = pages.typed_items(_shop(t, F.concat(F.lit('<script type="application/ld+json">'), menu, F.lit("</script>"))))
    first = F.when(F.col("name") == "side", 1).otherwise(0)
    return out.select("page_id", first.alias("ord"), "name", "price")


@query("extract_generic", f"select p_partkey as page_id, {_NAME} as name, round(case p_partkey % 3 when 0 then cast(p_partkey as double) / 100 when 1 then case when p_retailprice > 1000 then {_COST} / 100 else {_COST} end else {_COST} end, 2) as price from part where p_partkey % 3 <> 0 or p_partkey > 0")
def _(t: Tables) -> DataFrame:
    name, price = _text()
    cents = F.to_json(F.struct(name.alias("title"), F.struct(F.col("p_partkey").alias("cents")).alias("price")))
    major = F.to_json(F.struct(name.alias("itemName"), price.alias("basePrice")))
    other = F.to_json(F.struct(F.array(F.struct(name.alias("name"), F.struct(price.alias("value")).alias("price"))).alias("items")))
    blob = F.when(F.col("p_partkey") % 3 == 0, cents).when(F.col("p_partkey") % 3 == 1, major).otherwise(other)
    rows = pages.any_items(_shop(t, F.concat(F.lit('<script id="x" type="application/json">'), blob, F.lit("</script>"))), "USD")
    large = rows.select("page_id", "name", "price")
    return large.withColumn("price", F.round("price", 2))


@query("extract_dom", f"select p_partkey as page_id, k as ord, {_NAME} || case k when 0 then '' else ' large' end as name, {_COST} + k as price from part, range(2) as r(k) where {_COST} + k < 10000")
def _(t: Tables) -> DataFrame:
    name, price = _text()
    item = lambda n, p: F.concat(F.lit('<button data-item="1"><h3>'), n, F.lit("</h3><p class=cost>A$ "), F.format_number(p, 2), F.lit("</p></button>"))
    html = F.concat(F.lit("<html>"), item(name, price), item(F.concat(name, F.lit(" <b>large</b>")), price + 1), item(name, price))
    out = pages.dom_items(_shop(t, html), r'<button data-item="1">', "(?s)<h3>(.*?)</h3>", "(?s)<p class=cost>(.*?)</p>")
    return out.select("page_id", "ord", "name", "price")


@query("name_price_pairs", f"select p_partkey as page_id, 0 as ord, {_NAME} as name, {_COST} as price from part union all select p_partkey, 1, 'tea', 3.5 from part")
def _(t: Tables) -> DataFrame:
    name, price = _text()
    html = F.concat(F.lit('x={"price": "3.50", "name": "tea"}, {"name": "'), name, F.lit('", "basePrice": '), price.cast("decimal(12,2)").cast("string"), F.lit('}, {"name": "tea","price":3.50}, {"name": "free", "price": 0}'))
    out = pages.name_price_pairs(_shop(t, html).withColumn("html", F.regexp_replace("html", r',\{"name": "tea","price":3.50\}', "")), "page_id", "html")
    return out.select("page_id", F.when(F.col("name") == "tea", 1).otherwise(0).alias("ord"), "name", "price")


@query("name_from_markup", "select p_partkey as page_id, case p_partkey % 4 when 0 then p_name when 1 then p_name || '''s' when 2 then null else null end as name from part")
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey") % 4
    state = F.concat(F.lit('<script id="__NEXT_DATA__">{"props":{"initialReduxState":{"pageRestaurantDetail":{"entities":{"S1":{"name":"'), "p_name", F.lit('"}}}}}}</script>'))
    root = F.concat(F.lit('<script type="application/ld+json">{"@type":"Person","name":"no"}</script><script type="application/ld+json">{"@type":"Restaurant","name":"'), "p_name", F.lit('&apos;s"}</script>'))
    test = F.lit('<script type="application/ld+json">{"@type":"Restaurant","name":"Test store 7"}</script>')
    html = F.when(key == 0, state).when(key == 1, root).when(key == 2, test).otherwise(F.lit("<html></html>"))
    return _shop(t, html).select("page_id", pages.name_from_markup("html").alias("name"))


@query("extract_with_fallback", f"select p_partkey as page_id, 0 as ord, case when p_partkey % 2 = 0 then {_NAME} else 'quoted price' end as name, {_COST} as price from part union all select p_partkey, 1, 'quoted price', 7.0 from part where p_partkey % 2 = 1")
def _(t: Tables) -> DataFrame:
    name, price = _text()
    item = F.to_json(F.struct(F.lit("MenuItem").alias("@type"), name.alias("name"), F.array(F.struct(price.alias("price"))).alias("offers")))
    typed = F.concat(F.lit('<p>paid S$1</p><script type="application/ld+json">'), item, F.lit("</script>"))
    text = F.concat(F.lit("<p>paid S$"), F.format_number(price, 2), F.lit(" and S$7, again S$7.00</p>"))
    return pages.extract_with_fallback(_shop(t, F.when(F.col("p_partkey") % 2 == 0, typed).otherwise(text)), r"S\$\s*([0-9,]+(?:\.[0-9]+)?)")


_SCRIPT = {"jsonld": '<script type="application/ld+json">', "nextdata": '<script id="__NEXT_DATA__" type="application/json">'}


def _script(kind: str, tree):
    return F.concat(F.lit(_SCRIPT[kind]), F.to_json(tree), F.lit("</script>"))


@query("walk_items", f"""select p_partkey as page_id, 0 as ord, {_NAME} as name, {_COST} as price, case when p_size % 2 = 0 then 'USD' end as currency from part where p_size % 5 <> 0
union all select p_partkey, 1, 'set', p_size + 0.5, 'GBP' from part union all select p_partkey, 2, 'own', 7.25, null from part""")
def _(t: Tables) -> DataFrame:
    """A restaurant with a price of its own, which is no item, and a menu: a price in an offer, in a list of offers, in a specification, with text around it; and a node without a name."""
    name, price = _text()
    dollars = F.when(F.col("p_size") % 2 == 0, F.lit("USD"))
    first = F.struct(F.when(F.col("p_size") % 5 == 0, "Place").otherwise("MenuItem").alias("@type"), name.alias("name"), F.array(F.struct(F.concat(F.lit("about "), price.cast("decimal(12,2)").cast("string")).alias("price"), dollars.alias("priceCurrency"))).alias("offers"))
    second = F.struct(F.lit("set").alias("name"), F.struct((F.col("p_size") + 0.5).alias("price"), F.lit("GBP").alias("priceCurrency")).alias("priceSpecification"))
    third = F.struct(F.lit("own").alias("name"), F.lit(7.25).alias("price"), F.struct(F.lit(1.0).alias("price"), F.lit("EUR").alias("priceCurrency")).alias("offers"))
    tree = F.struct(F.lit("Restaurant").alias("@type"), F.lit("R").alias("name"), F.lit(9).alias("price"), F.struct(first.alias("a"), second.alias("b"), third.alias("c"), F.struct(F.lit(3).alias("price")).alias("d")).alias("menu"))
    out = pages.extract_items(_shop(t, _script("jsonld", tree)), "jsonld")
    return out.select("page_id", F.when(F.col("name") == "set", 1).when(F.col("name") == "own", 2).otherwise(0).alias("ord"), "name", "price", "currency")


@query("extract_nextdata", f"select p_partkey as page_id, {_NAME} as name, p_partkey / 100 as price, 'SGD' as currency from part where p_partkey > 0 union all select p_partkey, 'tea', 2.0, null from part")
def _(t: Tables) -> DataFrame:
    """Minor units, nothing below a node that has them, zero prices dropped, repeats once."""
    name, _ = _text()
    item = F.struct(name.alias("name"), F.col("p_partkey").alias("priceInMinorUnit"), F.lit("SGD").alias("priceCurrency"), F.array(F.struct(F.lit("extra").alias("name"), F.lit(1).alias("price"))).alias("below"))
    tea = F.struct(F.lit("tea").alias("name"), F.lit("2.00").alias("price"))
    none = F.struct(F.lit("sold out").alias("name"), F.lit(0).alias("priceInMinorUnit"))
    tree = F.struct(F.struct(F.array(item, item).alias("list"), none.alias("none"), F.array(tea, tea).alias("more")).alias("props"))
    return pages.extract_items(_shop(t, _script("nextdata", tree)), "nextdata").select("page_id", "name", "price", "currency")


@query("extract_raw_price", f"select p_partkey as page_id, {_NAME} as name, {_COST} as price from part union all select p_partkey, 'caf\u00e9 \"x\"', 3.5 from part")
def _(t: Tables) -> DataFrame:
    name, price = _text()
    html = F.concat(F.lit('var m=[{"name":"'), name, F.lit('","id":1,"raw_price":"'), price.cast("decimal(12,2)").cast("string"), F.lit('"},{"name":"caf\\u00e9 \\"x\\"","raw_price":3.5},{"name":"gone"},{"name":"zero","raw_price":0}]'))
    return pages.extract_items(_shop(t, html), "raw_price").select("page_id", "name", "price")


@query("cost_for_two", "select p_partkey as page_id, case p_partkey % 3 when 0 then p_partkey * 1000.0 when 1 then p_partkey + 0.5 end as amount, case when p_partkey % 3 < 2 then 'INR' end as currency from part")
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    html = F.when(key % 3 == 0, F.concat(F.lit("<p>Rs "), key.cast("string"), F.lit(",000</p> for two (approx.)"))).when(key % 3 == 1, F.concat(F.lit("cost for two: <b>"), key.cast("string"), F.lit(".50</b>"))).otherwise(F.lit("no price for one"))
    amount = pages.cost_for_two("html")
    return _shop(t, html).select("page_id", amount.alias("amount"), F.when(amount.isNotNull(), "INR").alias("currency"))


@query("price_tokens", f"select p_partkey as page_id, 'SGD' as currency, 2 as tokens, {_COST} + 1 as total from part union all select p_partkey, 'GBP', 1, cast(p_size as double) from part where p_size % 2 = 0")
def _(t: Tables) -> DataFrame:
    _, price = _text()
    html = F.concat(F.lit("<p>S$"), F.format_number(price, 2), F.lit("</p><p>S$ 1.00</p>"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\u00a3"), F.col("p_size").cast("string"))).otherwise(F.lit("")))
    out = pages.price_tokens(_shop(t, html), {"SGD": r"S\$\s?([0-9,]+(?:\.[0-9]{2})?)", "GBP": "\u00a3\\s?([0-9,]+(?:\\.[0-9]{2})?)"})
    return out.select("page_id", "currency", "tokens", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("context_items", "select p_partkey as page_id, 0 as ord, left('pad thai at ' || p_size || ' baht', 20) as name, cast(p_size as double) as price from part where p_size >= 10 union all select p_partkey, case when p_size >= 10 then 1 else 0 end, '(no fried rice, plate 95 b', 95.0 from part")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Menu: "), F.lit("-" * 90), F.lit("pad thai at "), F.col("p_size").cast("string"), F.lit(" baht "), F.lit("." * 100), F.lit(" tables at 120 baht "), F.lit("." * 60), F.lit("(no fried rice, plate 95 baht)"))
    return pages.context_items(_shop(t, text), [r"(\d+) baht"], ["fried rice", "pad thai"], text="html")


@query("price_label", "select p_partkey as page_id, case p_partkey % 4 when 0 then p_partkey * 1000.0 when 3 then null else p_size + 0.25 end as price, case p_partkey % 4 when 0 then 'IDR' when 1 then 'SGD' when 2 then 'USD' end as currency from part")
def _(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit(".25"))
    label = F.when(key % 4 == 0, F.concat(F.lit("Rp "), key.cast("string"), F.lit(".000"))).when(key % 4 == 1, F.concat(F.lit("now S$"), size)).when(key % 4 == 2, F.concat(F.lit("$ "), size)).otherwise(F.lit("market price"))
    return _shop(t, label).select("page_id", pages.parse_price_label("html").alias("p")).select("page_id", "p.price", "p.currency")


@query("node_types", "select p_partkey as page_id, 'Menu' as type, 1 as nodes from part union all select p_partkey, 'MenuItem', 1 + p_size % 3 from part union all select p_partkey, 'Dish', 1 from part where p_size % 3 > 0")
def _(t: Tables) -> DataFrame:
    return pages.node_types(_menus(t))


@query("priced_nodes", "select p_partkey as page_id, 1 + p_size % 3 as typed, 1 + p_size % 3 + case when p_size % 3 > 0 then 1 else 0 end + 1 as generic from part")
def _(t: Tables) -> DataFrame:
    return pages.priced_nodes(_menus(t))


def _menus(t: Tables) -> DataFrame:
    """Menus of one to three items (the second with two types, the first in a list of lists), a price of the menu's own and one without a name around it in a second block."""
    name, price = _text()
    k = F.col("p_size") % 3
    first = F.to_json(F.struct(F.lit("MenuItem").alias("@type"), name.alias("itemName"), F.struct(price.alias("unitPrice")).alias("cost")))
    second = F.lit('{"@type":["MenuItem","Dish"],"title":"two","listPrice":"1,250.00 USD","x":{"salePrice":0}}')
    third = F.lit('{"@type":"MenuItem","priceInCents":950}')
    items = F.concat_ws(",", F.concat(F.lit("[["), first, F.lit("]]")), F.when(k > 0, second), F.when(k > 1, third))
    html = F.concat(F.lit(_SCRIPT["jsonld"]), F.lit('{"@type":"Menu","name":"m","items":['), items, F.lit('],"more":{"@id":1,"displayPrice":"$5"},"amount":"'), F.when(k > 0, F.lit("3")).otherwise(F.lit("none")), F.lit('"}</script>'), F.lit(_SCRIPT["jsonld"]), F.lit('[{"price":1}]</script>'))
    return _shop(t, html)


@query("table_rows", f"select p_partkey as page_id, {_NAME} as name, {_COST} as value from part union all select p_partkey, 'total', p_size from part")
def _(t: Tables) -> DataFrame:
    name, price = _text()
    html = F.concat(F.lit("<table><tr><th>name</th><th>value</th></tr><tr><td> <b>"), name, F.lit("</b></td><td>x</td><td>"), F.format_number(price, 2), F.lit("</td></tr><tr><td>total</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr><tr><td></td><td>3</td></tr></table>"))
    return pages.table_rows(_shop(t, html))
