"""Archives, url rules and vectors against brute force, with the odd cases."""

import base64
import hashlib
import io
from collections import defaultdict

import numpy as np
import pyarrow.fs
import pytest
from tallyfield.llm import urls, vectors, warc
from tallyfield.llm.components import components
from tallyfield.llm.shared import shared_folder


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def check_archive(rows, pages, least=0):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    assert len(rows) == len(pages)
    html = {i: h or "" for i, _, h in pages}
    for r in rows:
        raw = html[r["page_id"]].encode()
        first = min(groups[html[r["page_id"]]])
        again = len(raw) >= least and r["page_id"] != first
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))


def test_archives(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows += [(10_000, None, None), (10_001, "http://a/\r\nX: y", ""), (10_002, "u", "<p>é</p>\r\n\r\nWARC/1.1"), (9_999, "v", "<p>é</p>\r\n\r\nWARC/1.1"), (10_003, "w", "z" * 3_000_000)]
    check_archive(warc.archived(pages_of(spark, rows)).collect(), rows)
    check_archive(warc.archived(pages_of(spark, rows), least=20).collect(), rows, 20)
    assert warc.archived(pages_of(spark, [])).count() == 0
    odd = warc.archived(pages_of(spark, [(None, "u", "x"), (3, "u", "x"), (3, "u", "x"), (None, None, None)]).selectExpr("*", "1 as digest", "2 as run", "3 as refers_to")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in odd) == [(0, "response", 0), (0, "revisit", 3), (3, "response", 0), (3, "response", 0)]


def test_archive_format(spark):
    """A dictionary in a leading skippable frame, then one frame a record."""
    import zstandard

    folder = shared_folder(spark) + "/format"
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id", "url", "html", "cast(null as long) as refers_to").coalesce(1)
    files = warc.write_archives(pages, folder).collect()
    store, _ = pyarrow.fs.FileSystem.from_uri(folder)
    raw = store.open_input_stream(files[0]["path"], compression=None).read()
    assert int.from_bytes(raw[:4], "little") == warc.DICT_FRAME and files[0]["bytes"] == len(raw) and files[0]["records"] == pages.count()
    size = int.from_bytes(raw[4:8], "little")
    words, rest = zstandard.ZstdCompressionDict(raw[8 : 8 + size]), raw[8 + size :]
    n = 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, n = one.unused_data, n + 1
    assert n == pages.count()
    alone = sum(len(zstandard.compress(warc.record(r["page_id"], r["url"], r["html"].encode(), None, "2020-01-01T00:00:00Z"))) for r in pages.collect())
    assert len(raw) - size < 0.95 * alone
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-5])))


def test_url_rules(spark):
    cases = {
        "http://Blog.Example.COM/en/7?x": ("blog.example.com", "/en/7", "example.com/en/", "block"),
        "https://www.example.com/en/a#b": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.net/es/x": ("a.net", "/es/x", "net/es/", "block"),
        "http://a.net/esx": ("a.net", "/esx", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "x://y://z.com/q": ("y:", "//z.com/q", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = urls.url_verdicts(pages_of(spark, [(i, u, None) for i, u in enumerate(cases)])).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == dict(enumerate(cases.values()))
    assert urls.url_verdicts(pages_of(spark, [])).count() == 0


def test_link_targets_plan_stays_small(spark):
    """Resolving a link names the link and its base often; the plan has each once, and not a product of all copies."""
    pages = pages_of(spark, [(1, "http://a.com/1", "<base href='/d/'><link rel=canonical href='x/../y?q=1&amp;r=2'><meta http-equiv=refresh content='0; url=//B.com/z'><link rel=icon href=i>")])
    links = urls.page_links(pages)
    assert len(links._jdf.queryExecution().analyzed().toString()) < 50_000
    assert sorted(map(tuple, links.collect())) == [("http://a.com/1", "http://a.com/d/y?q=1&r=2"), ("http://a.com/1", "http://b.com/z")]


def test_url_aliases(spark):
    canonical = lambda to: f"<html><LINK rel='canonical' href='{to}'></html>"
    rows = [
        (0, "http://a.org/1", canonical("http://b.org/2")),
        (1, "http://b.org/2", '<meta http-equiv="refresh" content="0; url=http://c.net/fr/3">'),
        (2, "http://c.net/fr/3", None),
        (3, "http://x.com/ok", canonical("http://c.net/fr/3")),
        (4, "http://d.org/4", canonical("/5")),
        (5, "http://d.org/5", "<link rel=stylesheet href=/s.css>"),
        (6, "http://e.org/6", canonical("http://gone.net/es/")),
        (7, "http://a.org/1", None),
    ]
    got = {r["page_id"]: (r["verdict"], r["via_alias"]) for r in urls.url_verdicts(pages_of(spark, rows)).collect()}
    assert got == {0: ("block", True), 1: ("block", True), 2: ("block", False), 3: ("allow", False), 4: ("allow", False), 5: ("allow", False), 6: ("block", True), 7: ("block", True)}
    redirects = spark.createDataFrame([("http://d.org/5", "http://e.org/6"), (None, "u")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(pages_of(spark, rows), redirects=redirects).collect()}
    assert got[4] == got[5] == "block" and got[3] == "allow"


def test_links_as_browsers_follow_them(spark):
    link = lambda href, more="": f'<head>{more}<link rel="canonical" href="{href}"></head>'
    refresh = '<meta http-equiv="refresh" content="0; url=../../net.html?a=1&amp;b=2">'
    rows = [
        (0, "http://a.org/x/y/z.html", refresh), (1, "http://A.org/net.html?a=1&b=2#top", link("http://b.NET/es/1")),  # up two folders, &amp;, host case, fragment
        (2, "http://c.org/p", link("es/3", '<base href="http://b.net/">')), (3, "http://d.org/p", f"<!-- {link('http://b.net/es/1')} --><p>"),  # base; a comment
        (4, "http://e.org/p", f"<script>'{link('http://b.net/es/1')}'</script>"), (5, "http://f.org/a/./b/../c", None), (6, "http://g.org/p", link("HTTP://F.org/a/c")),
        (7, "http://f.org/a/c", link("http://b.net/q/../fr/2")), (8, "http://h.net/es/../q", None), (9, "http://i.org/", link("http://h.net/q")), (10, "http://j.org/p", link("#top")),
        (11, "http://k.org/p?x=1", link("?x=2")), (12, "http://k.org/p?x=2", link("http://b.net/es/1")), (13, "http://l.org", link("es/1", "<base href=''>")),
    ]
    got = {r["page_id"]: (r["verdict"], r["via_alias"]) for r in urls.url_verdicts(pages_of(spark, rows)).collect()}
    blocked = {0, 1, 2, 5, 6, 7, 9, 11, 12}
    assert got == {i: ("block", i != 8) if i in blocked | {8} else ("allow", False) for i in range(14)}


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5300)] + [(7, 7)]
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def brute_vectors(v):
    x = np.array(v, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    while True:
        after = np.array([min(label[i], label[near[i]].min(initial=len(v))) for i in range(len(v))])
        if (after == label).all():
            return near.sum(1), label
        label = after


def test_near_vectors(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(800, 16))
    hot = [base[0] + r.normal(size=16) * 0.1 for _ in range(300)]
    mild = [b + r.normal(size=16) * 0.25 for b in base[:200]]
    v = np.array([*base, *hot, *mild, *([base[5]] * 40), *(3 * base[6:9])], dtype=np.float32)
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(i, [float(x) for x in y], 0) for i, y in enumerate(v)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] + [1.0] * 15, 1), (9005, [1.0, 2.0], 1), (None, rows[0][1], 1), (9006, [], 1), (9007, [float("inf")] * 16, 1)]
    got = {x["vec_id"]: x for x in vectors.near_vectors(spark.createDataFrame([*rows, *odd], schema)).collect()}
    assert len(got) == len(v) + 8
    n, label = brute_vectors(v)
    links = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (links <= n).all() and links.sum() >= 0.97 * n.sum()
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(v))]) > 0.97
    for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007, None):
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_near_vectors_finds_isolated_pairs_among_many_alike(spark):
    """Vectors around one direction fill a key's neighbourhood as a table of hundreds of thousands of unrelated ones does."""
    r = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    v = unit(unit(r.normal(size=64)) * 0.87 + 0.5 * unit(r.normal(size=(3000, 64))))
    away = r.normal(size=(300, 64))
    away = unit(away - (away * v[:300]).sum(axis=1)[:, None] * v[:300])
    v = np.concatenate([v, 0.905 * v[:300] + np.sqrt(1 - 0.905**2) * away])
    rows = spark.createDataFrame([(i, [float(y) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x for x in vectors.near_vectors(rows).collect()}
    n, label = brute_vectors(v)
    paired = n[:300] > 0
    assert paired.all() and np.mean([got[i]["n_links"] > 0 and got[i]["component_id"] == label[i] for i in range(300)]) > 0.98


def test_ids_at_the_ends_of_the_range(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "u", "same"), (7, "u", "same"), (None, "u", "same"), (high, "u", "other"), (None, "u", "other"), (None, "u", "alone"), (None, "u", "alone")]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    want = [(low, 4, "response", None), (7, 4, "revisit", low), (None, 4, "revisit", low), (high, 5, "response", None), (None, 5, "revisit", high), (None, 5, "response", None), (None, 5, "response", None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
