"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tallyfield import params


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: Column | str, table: dict, default=None) -> Column:
    """table[key] as a map literal, or default."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    found = F.create_map(*pairs)[col(key)] if pairs else F.lit(None)
    return found if default is None else F.coalesce(found, F.lit(default))


def geomean(x: Column | str) -> Column:
    """Geometric mean of what is positive; null without any."""
    return F.exp(F.avg(F.when(col(x) > 0, F.ln(col(x)))))


def month(x: Column | str) -> Column:
    """The first day of the month of a date or of text that can be read as one, else null."""
    return F.trunc(F.try_to_timestamp(col(x).cast("string")).cast("date"), "MM")


def month_text(x: Column | str) -> Column:
    return F.date_format(col(x), "yyyy-MM")


def hedonic(price: Column | str, signals: Column | str) -> tuple[Column, Column]:
    """(price adjusted for quality signals, whether it was); signals is a JSON array, and what isn't one counts as none."""
    has = lambda s: F.coalesce(F.array_contains(F.from_json(col(signals), "array<string>"), s), F.lit(False))
    by = F.when(has("PREMIUM_UPGRADE"), params.PREMIUM).otherwise(0.0) + F.when(has("PORTION_REDUCTION"), params.PORTION).otherwise(0.0)
    by = F.greatest(F.lit(-params.HEDONIC_CAP), F.least(F.lit(params.HEDONIC_CAP), by))
    return F.when(by == 0, col(price)).otherwise(col(price) * (1 + by)), by != 0


def any_of(text: Column, keywords: list[str]) -> Column:
    """Whether text contains any of the keywords, as they stand."""
    return reduce(lambda a, b: a | b, (text.contains(k) for k in keywords))


def classify(name: Column | str, rules: list[tuple[str, list[str]]], default: str = "OTHER") -> Column:
    """The category of the first rule one of whose keywords is in the lower-cased name; rule order decides."""
    low, out = F.lower(col(name)), F.lit(default)
    for category, keywords in reversed(rules):
        out = F.when(any_of(low, keywords), category).otherwise(out)
    return out


def signals(name: Column | str, rules: dict[str, list[str]]) -> Column:
    """Every signal with a keyword in the lower-cased name, in rule order."""
    low = F.lower(col(name))
    return F.filter(F.array(*(F.when(any_of(low, k), s) for s, k in rules.items())), lambda x: x.isNotNull())


def language(name: Column | str) -> Column:
    """th, hi, zh or ar by the first character of those scripts, ms by a Malay word, else en."""
    first = F.regexp_extract(col(name), "[\\u0E00-\\u0E7F\\u0900-\\u097F\\u4E00-\\u9FFF\\u0600-\\u06FF]", 0)
    malay = F.arrays_overlap(F.split(F.lower(col(name)), "\\s+"), F.array(*map(F.lit, params.MALAY_WORDS)))
    return F.when(first.rlike("[\\u0E00-\\u0E7F]"), "th").when(first.rlike("[\\u0900-\\u097F]"), "hi").when(first.rlike("[\\u4E00-\\u9FFF]"), "zh").when(first.rlike("[\\u0600-\\u06FF]"), "ar").when(malay, "ms").otherwise("en")


def truncated(text: Column | str, most: int) -> Column:
    """text, or its first most - 1 characters without trailing space and an ellipsis."""
    return F.when(F.length(col(text)) > most, F.concat(F.rtrim(F.left(col(text), F.lit(most - 1))), F.lit("…"))).otherwise(col(text))


def stripped_html(html: Column | str) -> Column:
    """Text of a page: comments, tags and entities gone, white space joined."""
    x = F.regexp_replace(col(html), "(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    x = F.regexp_replace(x, "&[a-zA-Z#0-9]+;", " ")
    return F.trim(F.regexp_replace(x, "[ \\t\\r\\n]+", " "))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), "^[a-z]+://([^/?#:]+)", 1))


def community(url: Column | str) -> Column:
    """The name behind /r/ in a forum url, else null."""
    return F.nullif(F.regexp_extract(col(url), "/r/([A-Za-z0-9_]+)(?:/|$)", 1), F.lit(""))


def mention_pattern(alias: Column | str) -> Column:
    """A pattern for an alias between characters that are neither letters nor digits, case aside."""
    return F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}])\\Q"), col(alias), F.lit("\\E(?![\\p{L}\\p{N}])"))


def pct_change(x: Column | str, before: Column) -> Column:
    return F.when(before != 0, (col(x) - before) / before * 100)


def latest(keys: list[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order)


def tier(p: Column | str) -> Column:
    return F.when(col(p) < 0.05, "p<0.05").when(col(p) < 0.10, "p<0.10").otherwise("n.s.")
