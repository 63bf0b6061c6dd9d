"""URL rules whose block decisions follow redirects and canonical links, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import small, stash

#: The rules of the pages query: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is one node of the plan and worked out once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lowered; without :// empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.octet_length(host) == F.char_length(host), F.lower(host)).otherwise(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; without :// empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls(url) with host, path, rule and rule_verdict of the longest fitting rule (null if none fits).

    A rule fits its host and every subdomain if the path starts with the rule's. The rules are a
    parameter of the job, so they become one expression of the scan and nothing is joined.
    """
    out = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _without_dots(path: Column) -> Column:
    """path with its . and .. segments followed."""
    start = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    left = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    return F.when(path.contains("/."), F.concat(left, F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def node_of(url: Column) -> Column:
    """The url under which its spellings meet: scheme and host lowered, dot segments followed, no fragment; one without :// is left as it is."""
    scheme = lambda u: F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    query = lambda u: F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1)
    node = lambda u: F.when(scheme(u) != "", F.concat(scheme(u), F.lit("://"), host_of(u), _let(path_of(u), _without_dots), query(u))).otherwise(u)
    return _let(url, node)


def _absolute(link: Column, base: Column) -> Column:
    """link as it stands in a page's markup, resolved against base (which is named often: a column or a variable) and brought to its node."""
    whole = lambda x: (
        F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), x)
        .when(x.startswith("//"), F.concat(F.regexp_extract(base, "^([^:/?#]*:)", 1), x))
        .when(x.startswith("/"), F.concat(F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1), x))
        .when(x.startswith("?"), F.concat(F.regexp_extract(base, "(?s)^([^?#]*)", 1), x))
        .when((x != "") & ~x.startswith("#"), F.concat(F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1), F.lit("/"), F.regexp_extract(base, "(?s)^.*?://[^/?#]*/((?:[^?#]*/)?)", 1), x))
    )
    return node_of(_let(F.trim(F.regexp_replace(link, "(?i)&(?:amp|#38|#x26);", "&")), whole))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of every canonical link and meta refresh in pages(url, html), as nodes.

    Links are resolved against the page's <base>, else its url; what stands in comments and scripts
    is no link. A page's targets are one expression of fixed size, exploded at its end, so that no
    filter above takes a copy of it: expressions put into each other took the driver's heap to plan.
    """
    href = lambda tag: F.regexp_extract(tag, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))", 0)
    value = lambda found: F.regexp_replace(found, r"(?is)^[a-z]+\s*=\s*[\"']?|[\"']$", "")
    canonical = lambda tag: tag.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b")
    refresh = lambda tag: tag.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    to = lambda tag: F.when(canonical(tag), value(href(tag))).otherwise(F.regexp_extract(tag, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1))

    def targets(html: Column) -> Column:
        own = F.nullif(value(href(F.regexp_extract(html, r"(?is)<base\b[^>]*>", 0))), F.lit(""))
        tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda tag: canonical(tag) | refresh(tag))
        return _let(F.coalesce(_absolute(own, F.col("url")), F.col("url")), lambda base: F.transform(tags, lambda tag: _absolute(to(tag), base)))

    seen = pages.where("url is not null and html is not null")
    html = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)", " ")
    links = seen.select("url", F.explode(_let(html, targets)).alias("dst")).where("dst is not null")
    return links.select(node_of(F.col("url")).alias("src"), "dst").where("dst <> src")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, via_alias.

    Urls joined by redirects(src, dst), canonical links or meta refreshes are aliases of each other,
    however long the chain; spellings of one url (see node_of) are one. A url that a rule fits gets
    that rule's verdict, so an explicit allow holds against blocked aliases. Without a rule a url is
    blocked if any alias is blocked by a rule, else allowed; via_alias says when an alias decided.
    Targets of links count as aliases even if no page of that url is in the table. Null urls, and
    urls without ://, have an empty host and path, fit no rule, and (null) have no aliases. Repeated
    urls are one url; repeated rows all come back; very long texts are searched whole; other columns
    are ignored; an empty table gives no rows.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    groups = components(links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    own = judged(pages.select("page_id", "url"), rules).withColumn("node", node_of(F.col("url")))
    # a page's rule is told by its url as it is spelt, a link's target's by its node
    spelt = own.where("rule_verdict = 'block' and url <> node").select(F.col("node").alias("id")).distinct()
    blocked = judged(groups.withColumnRenamed("id", "url"), rules).where("rule_verdict = 'block'").select("component")
    blocked = blocked.unionByName(groups.join(spelt, "id", "left_semi").select("component")).distinct()
    hit = stash(groups.join(blocked, "component", "left_semi").select(F.col("id").alias("node"), F.lit(True).alias("via_alias")), "aliases")
    out = own.join(small(hit), "node", "left")
    via = F.col("rule").isNull() & F.coalesce("via_alias", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(via, "block").otherwise("allow")).alias("verdict"), via.alias("via_alias"))


ORACLE = """
with u as (
  select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), h as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p
), r(verdict, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m as (
  select page_id, rhost || rpath as rule, verdict, row_number() over (partition by page_id order by length(rhost || rpath) desc) as rn
  from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select h.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from h left join (select * from m where rn = 1) x on x.page_id = h.page_id
"""
