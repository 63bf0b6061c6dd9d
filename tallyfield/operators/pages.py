"""Page to table extraction, page health, and archive-capture analytics."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.functions.columns import col

# Node types whose price is not an item's.
NOT_ITEMS = ["PostalAddress", "GeoCoordinates", "Restaurant", "FoodEstablishment", "Place", "LocalBusiness", "BreadcrumbList", "AggregateRating", "Review"]
# Keys under which a menu document nests its sections and items.
MENU_KEYS = ["hasMenuSection", "hasMenuItem", "itemListElement", "menu"]
# Keys of an item's name and of its price, in order of preference, in documents without a schema.
NAME_KEYS = ["name", "itemName", "title"]
PRICE_KEYS = ["price", "basePrice", "defaultPrice", "finalPrice", "priceMonetaryFields", "prices"]
# Inside a price, keys of an amount in minor units and of any amount; beside the latter, keys that say that it is in minor units.
MINOR_KEYS, AMOUNT_KEYS, CURRENCY_KEYS = ["cents", "pence"], ["unitAmount", "amount", "value"], ["currency", "currencyCode"]
# The largest plausible price of a currency in major units.
LARGE = {"USD": 1000, "GBP": 1000, "AUD": 1000, "SGD": 1000, "MYR": 1000, "INR": 5000}
# Fixed values of the structure report: name keys, price keys, those that may be in minor units, and item types.
ANY_NAME_KEYS = ["name", "itemName", "productName", "title", "displayName"]
ANY_PRICE_KEYS = ["price", "priceInCents", "priceInMinorUnit", "priceInMinor", "raw_price", "amount", "unitAmount", "unitPrice", "displayPrice", "minOrderPrice", "salePrice", "basePrice", "listPrice"]
PERHAPS_MINOR = ["priceInCents", "priceInMinor", "priceInMinorUnit", "unitAmount", "amount"]
ITEM_TYPES = ["MenuItem", "Offer", "AggregateOffer", "Product", "FoodEstablishment"]
#: Names that a platform gives to stores that are none.
PLACEHOLDER = r"^(?:test|do not use|closed|dead store|placeholder|store)\b|\b(?:test store|do not use|internal)\b"
#: Nodes that leave a task at a time.
NODES = 5000


def script_blocks(html: Column | str, kind: str) -> Column:
    """Contents of the script elements whose opening tag mentions `kind`; a missing close ends at the next tag or the page's end."""
    tag = f"(?is)<script[^>]*{kind}[^>]*>(.*?)(?:</script>|(?=<[a-z/!])|$)"
    return F.regexp_extract_all(col(html), F.lit(tag), F.lit(1))


def _and(schema: StructType, more: str) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(more).fields)


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def _flat(node: dict) -> list[tuple[str, str | None]]:
    """A node's own fields, and those of the objects right below it (of a list the first) under dotted names; "key{}" says that a key holds an object or a list with something in it."""
    out = []
    for key, x in node.items():
        if not isinstance(x, dict | list):
            out.append((key, _text(x)))
            continue
        if x:
            out.append((key + "{}", "list" if isinstance(x, list) else "object"))
        inner = x[0] if isinstance(x, list) and x else x
        if isinstance(inner, dict):
            out += [(f"{key}.{k}", _text(v)) for k, v in inner.items() if not isinstance(v, dict | list)]
    return out


def _nodes(tree, under: list[str] | None, leaf: tuple[str, str] | None, names: list[str]) -> Iterator[tuple]:
    """(depth, level, types, fields, named, kind) of every object of a JSON document, in document order, as a walk with a stack comes by it."""
    stack = [(tree, 0, 0, False, None)]
    while stack:
        x, depth, level, named, kind = stack.pop()
        if isinstance(x, list):
            stack.extend((y, depth + 1, level, named, kind) for y in reversed(x) if isinstance(y, dict | list))
        elif isinstance(x, dict):
            types = [t for t in (x.get("@type") if isinstance(x.get("@type"), list) else [x.get("@type")]) if isinstance(t, str)]
            named = named or any(isinstance(x.get(k), str) and x[k].strip() for k in names)
            kind = types[0] if types else kind
            yield depth, level, types, _flat(x), named, kind
            if not leaf or leaf[0] not in x or not x.get(leaf[1]):
                below = [y for k, y in x.items() if isinstance(y, dict | list) and (under is None or k in under)]
                stack.extend((y, depth + 1, level + 1, named, kind) for y in reversed(below))


def json_nodes(blocks: DataFrame, keep: list[str], blob: str, under: list[str] | None = None, leaf: tuple[str, str] | None = None, names: list[str] = ANY_NAME_KEYS) -> DataFrame:
    """(keep..., ord, depth, level, types, fields, named, kind): a row per object of the JSON document in `blob`, in document order; what doesn't parse has none.

    depth counts the objects and lists around a node, level the objects alone. types are its @type
    texts, kind the first of them, or that of the nearest object around it that has one; named says
    whether it or an object around it has a name under one of `names`; fields see _flat(). With
    `under` the walk goes down by these keys alone; with `leaf` not below a node that has the first of
    these keys and something under the second. Nodes leave the task as the walk comes by them, NODES at a time, however large a document is.
    """
    kept = blocks.select(*keep, F.col(blob).alias("_blob"))
    fields = pa.map_(pa.string(), pa.string())
    kinds = [("ord", pa.int64()), ("depth", pa.int32()), ("level", pa.int32()), ("types", pa.list_(pa.string())), ("fields", fields), ("named", pa.bool_()), ("kind", pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(b: pa.RecordBatch, row: list[int], rows: list[tuple]) -> pa.RecordBatch:
            own = [b[c].take(pa.array(row, pa.int64())) for c in keep]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*keep, *(n for n, _ in kinds)])

        for b in batches:
            row, rows = [], []
            for i, text in enumerate(b["_blob"]):
                try:
                    tree = json.loads(text.as_py() or "null")
                except (ValueError, RecursionError):
                    continue
                for k, node in enumerate(_nodes(tree, under, leaf, names)):
                    row.append(i)
                    rows.append((k, *node[:3], list(dict(node[3]).items()), *node[4:]))
                    if len(rows) == NODES:
                        yield batch(b, row, rows)
                        row, rows = [], []
            if rows:
                yield batch(b, row, rows)

    return kept.mapInArrow(work, _and(kept.drop("_blob").schema, "ord long, depth int, level int, types array<string>, fields map<string,string>, named boolean, kind string"))


def _field(name: str) -> Column:
    return F.col("fields")[name]


def _given(name: str) -> Column:
    """The field where it says something: neither empty, zero nor false."""
    return F.when(~_field(name).isin("", "false") & F.coalesce(_field(name).try_cast("double") != 0, F.lit(True)), _field(name))


def _has(name: str) -> Column:
    return F.map_contains_key("fields", name)


def _first(found: list[Column]) -> Column:
    return F.coalesce(*found)


def schema_items(nodes: DataFrame, keep: list[str], bound: float = 100_000.0) -> DataFrame:
    """(keep..., ord, name, price, currency) of the nodes of json_nodes() that have a name of their own and a price.

    The price is the node's own, else that of its first offer, else of its price specification: its
    digits and dots. Where priceInMinorUnit stands, that counts, in hundredths. Nodes of NOT_ITEMS
    give nothing; a price is above 0 and below the bound; names are cut to 120 characters.
    """
    minor = _has("priceInMinorUnit") & _given("name").isNotNull()
    own = _first([_field("price"), _field("offers.price"), _field("priceSpecification.price")])
    price = F.when(minor, _field("priceInMinorUnit").try_cast("double") / 100).when(~F.arrays_overlap("types", F.array(*map(F.lit, NOT_ITEMS))), F.regexp_replace(own, r"[^\d.]", "").try_cast("double"))
    beside = F.when(_field("price").isNull(), F.coalesce(_field("offers.priceCurrency"), F.when(_field("offers.price").isNull(), _field("priceSpecification.priceCurrency"))))
    currency = F.when(minor, _field("priceCurrency")).otherwise(F.coalesce(_given("priceCurrency"), beside))
    rows = nodes.select(*keep, "ord", F.left(_given("name"), F.lit(120)).alias("name"), price.alias("price"), currency.alias("currency"))
    return rows.where(F.col("name").isNotNull() & (F.col("price") > 0) & (F.col("price") < bound))


def menu_items(nodes: DataFrame, keep: list[str], most: int = 12) -> DataFrame:
    """(keep..., ord, name, price, currency) of MenuItem nodes with an offer's price, at most so many objects deep."""
    fits = (F.col("level") <= most) & F.array_contains("types", "MenuItem") & _given("name").isNotNull()
    rows = nodes.where(fits).select(*keep, "ord", F.left(_field("name"), F.lit(200)).alias("name"), _field("offers.price").try_cast("double").alias("price"), F.lit(None).cast("string").alias("currency"))
    return rows.where("price is not null")


def any_priced(nodes: DataFrame, keep: list[str], currency: str | None, most: int = 16) -> DataFrame:
    """(keep..., ord, name, price, currency) of any node with a name and a price under their usual keys, at most so many objects and lists deep.

    An amount under a minor-unit key, or beside a currency inside `price`, is in hundredths; without
    such a sign a price that is too large for its currency is taken for one in hundredths too.
    """
    small = lambda key: [F.when(_has(f"{key}.{k}"), F.struct(_field(f"{key}.{k}").alias("v"), F.lit(True).alias("minor"))) for k in MINOR_KEYS]
    beside = F.lit(False)
    for k in CURRENCY_KEYS:
        beside = beside | _has(f"price.{k}")
    plain = lambda key: F.struct(_first([_given(f"{key}.{k}") for k in AMOUNT_KEYS]).alias("v"), beside.alias("minor"))
    found = []
    for key in PRICE_KEYS:
        found += [F.when(_given(key).isNotNull(), F.struct(_field(key).alias("v"), F.lit(False).alias("minor"))), F.when(_field(f"{key}{{}}") == "object", F.coalesce(*small(key), plain(key))), F.when(_field(f"{key}{{}}") == "list", F.struct(F.lit(None).cast("string").alias("v"), F.lit(False).alias("minor")))]
    rows = nodes.where(F.col("depth") <= most).select(*keep, "ord", _first([_given(k) for k in NAME_KEYS]).alias("name"), F.coalesce(*found).alias("p"))
    value = F.col("p.v").try_cast("double")
    large = F.lit(LARGE.get(currency or "", float("inf")))
    price = F.when(F.col("p.minor") | (value > large), value / 100).otherwise(value)
    rows = rows.select(*keep, "ord", F.left("name", F.lit(200)).alias("name"), price.alias("price"), F.lit(currency).cast("string").alias("currency"))
    return rows.where((F.col("price") > 0) & (F.col("price") < 1_000_000) & F.col("name").isNotNull()).withColumn("price", F.round("price", 2))


def _blocks(pages: DataFrame, kind: str) -> DataFrame:
    return pages.select("page_id", F.posexplode(script_blocks("html", kind)).alias("block", "blob"))


def _in_page_order(rows: DataFrame) -> DataFrame:
    """rows(page_id, block, ord, ...) numbered over the page; of equal names and prices the first stays."""
    order = Window.partitionBy("page_id").orderBy("block", "ord")
    first = Window.partitionBy("page_id", F.lower("name"), F.round("price", 2)).orderBy("block", "ord")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return rows.withColumn("ord", F.row_number().over(order) - 1).select("page_id", "ord", "name", "price", "currency")


def typed_items(pages: DataFrame) -> DataFrame:
    """(page_id, ord, name, price, currency) of the MenuItem nodes in a page's JSON-LD blocks."""
    return _in_page_order(menu_items(json_nodes(_blocks(pages, "ld\\+json"), ["page_id", "block"], "blob", under=MENU_KEYS), ["page_id", "block"]))


def any_items(pages: DataFrame, currency: str | None = None, kind: str = "(?:json|__NEXT_DATA__)") -> DataFrame:
    """(page_id, ord, name, price, currency) of all named and priced nodes in a page's JSON scripts; see any_priced()."""
    return _in_page_order(any_priced(json_nodes(_blocks(pages, kind), ["page_id", "block"], "blob"), ["page_id", "block"], currency))


def dom_items(pages: DataFrame, marker: str, name: str, price: str, most: int = 4000, bound: float = 10_000.0) -> DataFrame:
    """(page_id, ord, name, price, currency) of markup items: a page is cut at the marker, and each part's first `most` characters give the first match of the name and of the price pattern."""
    from tallyfield.functions.columns import stripped_html

    parts = pages.where(F.regexp_like("html", F.lit(marker))).select("page_id", F.posexplode(F.slice(F.split("html", marker), 2, 1_000_000)).alias("ord", "part"))
    part = F.left("part", F.lit(most))
    rows = parts.select("page_id", F.lit(0).alias("block"), "ord", F.left(stripped_html(F.regexp_extract(part, name, 1)), F.lit(120)).alias("name"), F.regexp_extract(F.regexp_replace(stripped_html(F.regexp_extract(part, price, 1)), ",", ""), r"(\d+(?:\.\d{1,2})?)", 1).try_cast("double").alias("price"), F.lit(None).cast("string").alias("currency"))
    return _in_page_order(rows.where((F.col("name") != "") & (F.col("price") > 0) & (F.col("price") < bound)))


def name_price_pairs(texts: DataFrame, key: str, text: str, most: int = 60, bound: float = 10_000.0) -> DataFrame:
    """(key, ord, name, price) of name and price fields that stand side by side in either order, name first ones before the others; at most `most` of each key."""
    name, price = r'"name"\s*:\s*"([^"]{2,80})"', r'"(?:price|basePrice|defaultPrice|regularPrice)"\s*:\s*"?(\d+(?:\.\d{1,2})?)"?'
    found = lambda p, n, v, way: F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(n)).alias("n"), F.regexp_extract_all(text, F.lit(p), F.lit(v)).alias("v")), lambda x, i: F.struct(F.lit(way).alias("way"), i.alias("at"), x["n"].alias("name"), x["v"].try_cast("double").alias("price")))
    rows = texts.select(key, F.inline(F.concat(found(name + r"\s*,\s*" + price, 1, 2, 0), found(price + r"\s*,\s*" + name, 2, 1, 1)))).where((F.col("price") > 0) & (F.col("price") < bound))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(key, "name", "price").orderBy("way", "at"))).where("k = 1")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("way", "at")) - 1).where(F.col("ord") < most)
    return rows.select(key, "ord", "name", "price")


def name_from_markup(html: Column | str, most: int = 100) -> Column:
    """A page's own name: of the store in its state script, else of its first root-level Restaurant in JSON-LD (entities decoded); null for labels that stand for no store."""
    state = F.get(script_blocks(html, "__NEXT_DATA__"), F.lit(0))
    stores = F.from_json(F.get_json_object(state, "$.props.initialReduxState.pageRestaurantDetail.entities"), "map<string, struct<name: string>>")
    store = F.nullif(F.trim(F.get(F.map_values(stores), F.lit(0))["name"]), F.lit(""))
    root = F.filter(script_blocks(html, "ld\\+json"), lambda x: (F.get_json_object(x, "$['@type']") == "Restaurant") & (F.coalesce(F.get_json_object(x, "$.name"), F.lit("")) != ""))
    named = F.get_json_object(F.get(root, F.lit(0)), "$.name")
    for entity, plain in (("&apos;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        named = F.replace(named, F.lit(entity), F.lit(plain))
    named = F.nullif(F.trim(named), F.lit(""))
    return F.coalesce(F.left(store, F.lit(most)), F.when(~F.lower(named).rlike(PLACEHOLDER), F.left(named, F.lit(most))))


def extract_with_fallback(pages: DataFrame, price: str, typed_most: int = 30, text_most: int = 20, bound: float = 500_000.0, quoted: str = "quoted price") -> DataFrame:
    """(page_id, ord, name, price): a page's first typed items; of pages without any, the first distinct amounts that the price pattern's group finds in its text."""
    from tallyfield.functions.columns import stripped_html

    typed = typed_items(pages).where(F.col("ord") < typed_most).select("page_id", "ord", "name", "price")
    rest = pages.join(typed.select("page_id").distinct(), "page_id", "left_anti")
    amounts = F.transform(F.regexp_extract_all(stripped_html("html"), F.lit(price), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    good = F.filter(F.array_distinct(amounts), lambda x: (x > 0) & (x < bound))
    text = rest.select("page_id", F.posexplode(F.slice(good, 1, text_most)).alias("ord", "price")).select("page_id", "ord", F.lit(quoted).alias("name"), "price")
    return typed.unionByName(text)


def extract_items(pages: DataFrame, profile: str, bound: float = 100_000.0) -> DataFrame:
    """(page_id, ord, name, price, currency) by profile: jsonld or nextdata script blocks, or raw_price name/price pairs; first of equals stays."""
    if profile == "raw_price":
        pair = r'"name"\s*:\s*"((?:[^"\\]|\\.)*)"[^{}]{0,400}?"raw_price"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)'
        zipped = F.arrays_zip(F.regexp_extract_all("html", F.lit(pair), F.lit(1)).alias("n"), F.regexp_extract_all("html", F.lit(pair), F.lit(2)).alias("p"))
        rows = pages.select("page_id", F.posexplode(zipped).alias("ord", "x")).select("page_id", "ord", F.get_json_object(F.concat(F.lit('{"v":"'), F.col("x.n"), F.lit('"}')), "$.v").alias("name"), F.col("x.p").cast("double").alias("price"), F.lit(None).cast("string").alias("currency"))
        rows = rows.where((F.col("price") > 0) & (F.col("price") < bound))
    else:
        kind = {"jsonld": "ld\\+json", "nextdata": "__NEXT_DATA__"}[profile]
        rows = schema_items(json_nodes(_blocks(pages, kind), ["page_id", "block"], "blob", leaf=("priceInMinorUnit", "name")), ["page_id", "block"], bound)
        rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("block", "ord")) - 1).drop("block")
    first = Window.partitionBy("page_id", "name", F.round("price", 2), "currency").orderBy("ord")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def price_tokens(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(page_id, currency, tokens, values) of each currency's amounts in the page's text; a pattern's first group is the number."""
    by = [F.struct(F.lit(c).alias("currency"), F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias("v")) for c, p in patterns.items()]
    rows = pages.select("page_id", F.explode(F.array(*by)).alias("t")).where(F.size("t.v") > 0)
    return rows.select("page_id", "t.currency", F.size("t.v").alias("tokens"), F.transform("t.v", lambda x: F.regexp_replace(x, ",", "").try_cast("double")).alias("values"))


def context_items(pages: DataFrame, patterns: list[str], keywords: list[str], before: int = 80, after: int = 40, low: float = 10, high: float = 5000, most: int = 6, text: str = "text") -> DataFrame:
    """(page_id, ord, name, price) of prices in a page's text with a keyword near them: from `before` characters ahead of the price to `after` behind it.

    The places of all prices and of each keyword are sorted arrays of their own, matched by interval,
    so a text is gone through once for each pattern and keyword however many prices it has. Of
    several keywords near a price the first of the list counts, at its first place there; name is what
    stands from 8 characters ahead of it to 12 behind, inside the window, cut to 60. Patterns come one after
    the other; of equal names (case aside) and prices the first stays; at most `most` a page.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p) for p in patterns]
        for b in batches:
            row, out = [], []
            for i, x in enumerate(b["text"]):
                page, seen, n = x.as_py() or "", set(), 0
                prices = [(m.start(), m.end(), _number(m.group(1))) for p in compiled for m in p.finditer(page)]
                lower = page.lower() if prices else ""
                if len(lower) != len(page):
                    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
                start = np.array([max(0, s - before) for s, _, _ in prices], np.int64)
                end = np.array([min(len(page), e + after) for _, e, _ in prices], np.int64)
                at, which = np.full(len(prices), -1), np.full(len(prices), -1)
                for k, word in enumerate(keywords if prices else []):
                    places = np.array([m.start() for m in re.finditer(f"(?={re.escape(word)})", lower)], np.int64)
                    if len(places):
                        first = places[np.minimum(np.searchsorted(places, start), len(places) - 1)]
                        near = (which < 0) & (first >= start) & (first + len(word) <= end)
                        at[near], which[near] = first[near], k
                for j in np.flatnonzero(which >= 0):
                    price = prices[j][2]
                    if n == most or price is None or not low <= price <= high:
                        continue
                    name = page[max(start[j], at[j] - 8) : min(end[j], at[j] + len(keywords[which[j]]) + 12)].strip(" .,;:-\u2014")
                    name = re.sub(r"\s+", " ", name)[:60]
                    if (name.lower(), price) not in seen:
                        seen.add((name.lower(), price))
                        row.append(i)
                        out.append((n, name, price))
                        n += 1
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b["page_id"].take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.float64()), strict=True))], names=["page_id", "ord", "name", "price"])

    rows = pages.select("page_id", F.col(text).alias("text"))
    return rows.mapInArrow(work, _and(rows.drop("text").schema, "ord int, name string, price double"))


def _number(text: str) -> float | None:
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return None


def parse_price_label(label: Column | str) -> Column:
    """(price, currency) struct of a labelled price: symbol or code before or behind the number; dots group thousands in rupiah."""
    text = col(label)
    number = lambda p: F.regexp_extract(text, p, 1)
    tries = [("IDR", r"(?i)(?:Rp\.?|IDR)\s*([0-9]+(?:\.[0-9]{3})*)", True), ("SGD", r"(?i)(?:S\$|SGD)\s*([0-9,]+(?:\.[0-9]+)?)", False), ("MYR", r"(?i)(?:RM|MYR)\s*([0-9,]+(?:\.[0-9]+)?)", False), ("AUD", r"(?i)(?:A\$|AUD)\s*([0-9,]+(?:\.[0-9]+)?)", False), ("GBP", r"(?:£|GBP)\s*([0-9,]+(?:\.[0-9]+)?)", False), ("INR", r"(?:₹|Rs\.?|INR)\s*([0-9,]+(?:\.[0-9]+)?)", False), ("THB", r"(?i)(?:฿|THB)\s*([0-9,]+(?:\.[0-9]+)?)", False), ("USD", r"(?:US\$|\$|USD)\s*([0-9,]+(?:\.[0-9]+)?)", False)]
    found = [F.when(number(p) != "", F.struct(F.regexp_replace(number(p), "[.,]" if dots else ",", "").try_cast("double").alias("price"), F.lit(c).alias("currency"))) for c, p, dots in tries]
    return F.coalesce(*found)


def cost_for_two(html: Column | str) -> Column:
    """The amount of a page's one "for two" signal, tags aside and thousands joined; null without one."""
    text = F.regexp_replace(col(html), "<[^>]+>", " ")
    x = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)([0-9][0-9.,]*)\s*(?:[^0-9<]{0,20})for\s+two", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?i)for\s+two[^0-9]{0,20}([0-9][0-9.,]*)", 1), F.lit("")))
    return F.regexp_replace(x, r"[.,](?=[0-9]{3}(?:[^0-9]|$))", "").try_cast("double")


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, name, value) of html table rows whose first cell is text and whose last number-like cell is a value."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    rows = rows.withColumn("c", cells).where(F.size("c") >= 2)
    return rows.select("page_id", F.col("c")[0].alias("name"), F.regexp_replace(F.element_at("c", -1), ",", "").try_cast("double").alias("value")).where("value is not null and name <> ''")


def name_from_url(url: Column | str, label: str) -> Column:
    """A store's name from the last path segment that isn't an action: decoded, dashes as spaces, cut to 80 characters, with a label."""
    path = F.regexp_extract(col(url), "^[a-z]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~F.lower(p).isin("menu", "order", "delivery", "restaurant", "store"))
    slug = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    slug = F.coalesce(F.try_url_decode(slug), slug)
    named = F.left(F.trim(F.regexp_replace(F.regexp_replace(slug, "\\.html?$", ""), "[-_]+", " ")), F.lit(80))
    hashed = F.concat(F.lit("store "), F.left(F.md5(slug), F.lit(8)))
    return F.concat(F.when(slug.startswith("$"), hashed).otherwise(named), F.lit(f" ({label})"))


def page_health(html: Column | str, title_words: Column) -> Column:
    """blocked, dead, menu (three distinct prices or more), match (the title has all entity words) or other."""
    low = F.lower(col(html))
    title = F.regexp_extract(low, "(?s)<title>(.*?)</title>", 1)
    prices = F.size(F.array_distinct(F.regexp_extract_all(col(html), F.lit(r"[$£€]\s?[0-9]+(?:\.[0-9]{2})?"), F.lit(0))))
    return (
        F.when(low.rlike("captcha|access denied|are you a robot"), "blocked").when(low.rlike("404 not found|page not found|no longer available"), "dead")
        .when(prices >= 3, "menu").when(F.forall(title_words, lambda w: title.contains(w)), "match").otherwise("other")
    )


def redirected_to_listing(asked: Column | str, final: Column | str) -> Column:
    """Whether the final path is empty or a strict prefix, by segments, of the asked one."""
    seg = lambda u: F.filter(F.split(F.regexp_extract(col(u), "^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    a, b = seg(asked), seg(final)
    return (F.size(b) < F.size(a)) & ((F.size(b) == 0) | (F.slice(a, F.lit(1), F.greatest(F.size(b), F.lit(1))) == b))


def node_types(pages: DataFrame, kind: str = "ld\\+json") -> DataFrame:
    """(page_id, type, nodes): how often each @type stands in a page's JSON scripts."""
    nodes = json_nodes(_blocks(pages, kind), ["page_id"], "blob")
    return nodes.select("page_id", F.explode("types").alias("type")).groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("nodes"))


def priced_nodes(pages: DataFrame, kind: str = "ld\\+json") -> DataFrame:
    """(page_id, typed, generic): prices under any usual key of a node that has a name, or stands in one that has; typed ones are of an item type or in a node of one.

    A price is the first number of its text; prices over 100 under keys of minor units are taken in
    hundredths. Pages without any are left out.
    """
    nodes = json_nodes(_blocks(pages, kind), ["page_id"], "blob").where("named")
    number = lambda k: F.regexp_extract(F.regexp_replace(_field(k), ",", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    scaled = lambda k: F.when(number(k) > 100, number(k) / 100).otherwise(number(k)) if k in PERHAPS_MINOR else number(k)
    count = sum((F.coalesce(scaled(k) > 0, F.lit(False)).cast("long") for k in ANY_PRICE_KEYS), F.lit(0))
    typed = F.coalesce(F.col("kind").isin(ITEM_TYPES), F.lit(False)) | F.arrays_overlap("types", F.array(*map(F.lit, ITEM_TYPES)))
    out = nodes.select("page_id", count.alias("n"), typed.alias("typed")).groupBy("page_id").agg(F.sum(F.when(F.col("typed"), F.col("n")).otherwise(0)).alias("typed"), F.sum("n").alias("generic"))
    return out.where("generic > 0")


def attempt_outcome(html: Column | str, items: Column) -> Column:
    """What came of reading a page: hit, or the reason for none (no_page, blocked, dead, no_data, no_items)."""
    low = F.lower(col(html))
    return (
        F.when(F.coalesce(F.length(low), F.lit(0)) == 0, "no_page").when(F.coalesce(items, F.lit(0)) > 0, "hit").when(low.rlike("captcha|access denied|are you a robot"), "blocked")
        .when(low.rlike("404 not found|page not found|no longer available"), "dead").when(~low.rlike("(?i)<script[^>]*json"), "no_data").otherwise("no_items")
    )


def yield_report(items: DataFrame, pages: DataFrame, target: str, reasons: int = 2) -> DataFrame:
    """Per target of pages(page_id, target, html): attempts, hits, mean and best number of items of a hit, and the most frequent reasons of failed attempts with their numbers (ties by name).

    Failures are counted by target and reason before the top is taken, so a target's state is its few reasons.
    """
    by = pages.select("page_id", target, "html").join(items.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")), "page_id", "left")
    by = by.select(target, F.coalesce("n", F.lit(0).cast("long")).alias("n"), attempt_outcome("html", F.col("n")).alias("outcome"))
    counts = by.groupBy(target, "outcome").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.max("n").alias("best"))
    hit = F.col("outcome") == "hit"
    tops = F.slice(F.array_sort(F.collect_list(F.when(~hit, F.struct((-F.col("k")).alias("less"), F.col("outcome").alias("reason"))))), 1, reasons)
    out = counts.groupBy(target).agg(
        F.sum("k").alias("attempts"), F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("hits"), F.round(F.sum(F.when(hit, F.col("total"))) / F.sum(F.when(hit, F.col("k"))), 4).alias("mean_items"), F.max("best").alias("best"), tops.alias("tops")
    )
    named = F.array_join(F.transform("tops", lambda x: F.concat(x["reason"], F.lit(": "), (-x["less"]).cast("string"))), ", ")
    return out.withColumn("top_reasons", named).drop("tops")


# captures


def distributed_sample(captures: DataFrame, keys: list[str], period: str, k: int, most: int) -> DataFrame:
    """At most k captures of each period and `most` of each key, in time order; a url counts once, at its first capture."""
    first = captures.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "url").orderBy("at", "length"))).where("n = 1").drop("n")
    out = first.withColumn("period", F.date_trunc(period, "at")).withColumn("n", F.row_number().over(Window.partitionBy(*keys, "period").orderBy("at", "url"))).where(F.col("n") <= k)
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "url"))).where(F.col("n") <= most).drop("n")


def capture_coverage(captures: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Snapshots, distinct urls, urls captured twice or more, first and last time, and whether the list was cut at the limit."""
    by = captures.groupBy(*keys, "url").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
    return by.groupBy(*keys).agg(F.sum("n").alias("snapshots"), F.count(F.lit(1)).alias("distinct_urls"), F.count_if(F.col("n") >= 2).alias("repeated_urls"), F.min("a").alias("earliest"), F.max("b").alias("latest"), (F.sum("n") >= limit).alias("truncated"))


def source_verdict(captures: DataFrame, keys: list[str], least_bytes: int = 3000) -> DataFrame:
    """usable, marginal or drop by the number of large pages and of distinct years."""
    out = captures.groupBy(*keys).agg(F.count_if(F.col("length") > least_bytes).alias("pages"), F.count_distinct(F.year("at")).alias("years"))
    return out.withColumn("verdict", F.when((F.col("pages") >= 50) & (F.col("years") >= 3), "usable").when((F.col("pages") >= 20) & (F.col("years") >= 2), "marginal").otherwise("drop"))


def best_platform(coverage: DataFrame, key: str, platform: str, least: int) -> DataFrame:
    """The platform of each key with the most distinct urls, and whether it passes the gate."""
    best = coverage.groupBy(key).agg(F.max_by(F.struct(platform, "distinct_urls"), F.struct("distinct_urls", platform)).alias("m"))
    return best.select(key, f"m.{platform}", "m.distinct_urls", (F.col("m.distinct_urls") >= least).alias("passes"))


def sample_without_junk(captures: DataFrame, key: str, markers: list[str], k: int) -> DataFrame:
    """k real captures of each key by time, and how many junk urls it had; junk doesn't use up the quota."""
    junk = F.lower("url").rlike("|".join(markers))
    counted = captures.withColumn("junk", F.count_if(junk).over(Window.partitionBy(key))).where(~junk)
    return counted.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at", "url"))).where(F.col("n") <= k).drop("n")
