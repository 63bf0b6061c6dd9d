"""Models, alias graphs and the pipeline against brute force."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyfield.llm import mixing, quality, urls, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def naive_score(p, text):
    """The network spelt out: loops over chunks, places and filters."""
    raw = list((text or "").encode())
    step, chunks, at = quality.CHUNK - quality.SHARED, [], 0
    while True:
        chunks.append((raw[at : at + quality.CHUNK] + [quality.PAD] * quality.CHUNK)[: quality.CHUNK])
        if at + quality.CHUNK >= len(raw):
            break
        at += step
    tops = []
    for ids in chunks:
        x = p["emb"][ids].astype(float)
        best = np.full(quality.FILTERS, -np.inf)
        for place in range(quality.CHUNK - quality.WIDTH + 1):
            best = np.maximum(best, x[place : place + quality.WIDTH].ravel() @ p["k"].astype(float))
        tops.append(np.maximum(best + p["b"], 0))
    doc = np.r_[np.max(tops, axis=0), np.mean(tops, axis=0)]
    return 1 / (1 + math.exp(-float(doc @ p["v"] + p["c"][0])))


TEXTS = ["", "a", "x" * 512, "quick brown fox " * 60, "é" * 700, "".join(chr(33 + i * 7 % 90) for i in range(1500))]


def test_quality_forward_pass():
    net = quality.ByteNet(3)
    net.p["v"] += np.random.default_rng(1).normal(0, 0.3, net.p["v"].shape).astype(np.float32)
    assert np.allclose(net.score([*TEXTS, None]), [naive_score(net.p, t) for t in [*TEXTS, None]], atol=1e-5)


def test_quality_gradient():
    net = quality.ByteNet(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["b"] += np.random.default_rng(8).uniform(0.02, 0.1, quality.FILTERS)  # padding alone would stand exactly at the kink of the response
    parts, y = [quality.chunks_of(t) for t in TEXTS], np.array([0, 1, 0, 1, 1, 0], np.float32)

    def loss():
        s = net.score(TEXTS)
        return float(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))

    g, r, checked = net._gradient(parts, y), np.random.default_rng(2), 0
    for name, x in net.p.items():
        places = [tuple(r.integers(0, n) for n in x.shape) for _ in range(25)] if name != "emb" else [(b, e) for b in (ord("x"), ord("q"), 0xC3) for e in range(quality.EMBED)]
        for at in places:
            was, h = x[at], 1e-6
            x[at] = was + h
            up = loss()
            x[at] = was - h
            down = loss()
            x[at] = was
            assert abs((up - down) / (2 * h) - g[name][at]) < 1e-4 + 0.02 * abs(g[name][at]), (name, at)
            checked += abs(g[name][at]) > 1e-4
    assert checked > 20


def test_quality_takes_integer_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    assert [r["doc_id"] for r in quality.quality_scores(docs, none).orderBy("doc_id").collect()] == [1, 2]


def test_mixing_posteriors_and_rates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    labelled, domains = mixing.label_domains(labels), list(mixing.TARGETS)
    cells = {r["doc_id"]: r["c"] for r in docs.select("doc_id", mixing._cells(mixing._words()).alias("c")).collect()}
    domain = {r["doc_id"]: r["domain"] for r in labelled.collect()}
    counts, n_docs = {d: np.zeros(mixing.CELLS) for d in domains}, dict.fromkeys(domains, 0)
    for i, d in domain.items():
        n_docs[d] += 1
        np.add.at(counts[d], np.array(cells[i], int) - 1, 1)
    logp = {d: np.log((c + 0.5) / (c.sum() + 0.5 * mixing.CELLS)) for d, c in counts.items()}
    rows = {r["doc_id"]: r for r in mixing.mixed_rates(docs, labelled).collect()}
    post = {}
    for i, c in cells.items():
        s = np.array([math.log(n_docs[d] + 0.5) + logp[d][np.array(c, int) - 1].sum() * min(1.0, mixing.EVIDENCE / max(len(c), 1)) for d in domains])
        post[i] = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert rows[i]["n_tokens"] == len(c)
        assert np.allclose([rows[i][f"p_{d}"] for d in domains], post[i], atol=0.0151), i
    p = np.array([[rows[i][f"p_{d}"] for d in domains] for i in rows])
    n, rate = np.array([rows[i]["n_tokens"] for i in rows], float), np.array([rows[i]["rate"] for i in rows])
    got = (n * rate) @ p / n.sum()
    want = np.array(list(mixing.TARGETS.values()))
    fitted = np.ones(len(n))  # projected gradient over the documents themselves, step by step
    moments = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-9)
    for _ in range(40):
        off = (n * fitted) @ p / n.sum() - want
        if np.abs(moments @ off).max() < 1e-6:
            break
        fitted = np.maximum(0, fitted - p @ (moments @ off))
    assert (rate >= 0).all() and np.allclose(rate, fitted, atol=1e-4)
    assert np.abs(got - want).sum() <= np.abs(n @ p / n.sum() - want).sum() + 1e-9


def test_mixing_of_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b" if i % 3 else None, 5, 6, 7) for i in range(40)], "doc_id long, text string, copies int, times int, rate int")
    labelled = spark.createDataFrame([(i, "plain" if i % 2 else "toxic") for i in range(10)], "doc_id long, domain string")
    out = mixing.mixed_documents(docs, labelled)
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} <= {(5, 6, 7)}
    assert mixing.mixed_documents(docs.limit(0), labelled).count() == 0


def test_url_aliases_of_random_graphs(spark):
    r = random.Random(5)
    hosts = ["a.org", "shop.example.com", "www.example.com", "b.net", "c.net", "d.com", "example.com", "e.org"]
    known = sorted({f"http://{r.choice(hosts)}/{r.choice(['en/', 'es/', 'fr/', 'x/', ''])}{r.randrange(60)}" for _ in range(400)})
    redirects = [(r.choice(known), r.choice(known)) for _ in range(150)]
    pages, edges = [], list(redirects)
    for i, u in enumerate(known):
        to = r.choice(known) if i % 4 == 0 else None
        kind = f'<link rel="canonical" href="{to}">' if i % 8 == 0 else f'<meta http-equiv="refresh" content="0; url={to}">'
        pages.append((i, u, None if to is None else kind))
        edges += [(u, to)] if to else []
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        low[root(a)] = root(b)

    def rule(u):
        host, _, path = u.split("://")[1].partition("/")
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    blocked = {root(u) for u in known if rule(u) == "block"}
    want = {i: rule(u) or ("block" if root(u) in blocked else "allow") for i, u, _ in pages}
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x["page_id"]: x["verdict"] for x in urls.url_verdicts(frame, redirects=spark.createDataFrame(redirects, "src string, dst string")).collect()}
    assert got == want and sum(rule(u) is None and want[i] == "block" for i, u, _ in pages) > 10
    assert sum(rule(u) == "allow" and root(u) in blocked for u in known) > 10


def test_vectors_of_extreme_size(spark):
    v = [[1e200, 1e200], [2e200, 2.1e200], [1e-200, 1e-200], [1.0, 0.1], [1e-310, 0.0]]
    rows = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as component")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(rows).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3)}


@pytest.mark.parametrize("spread", [0.05, 0.12, 0.3])
def test_link_counts_over_blocks(spark, monkeypatch, spread):
    """Components of several blocks: core members only, some others, others only."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    r = np.random.default_rng(4)
    base = r.normal(size=12)
    v = base + r.normal(size=(260, 12)) * spread * np.linalg.norm(base) / math.sqrt(12) * 2
    x = v / np.linalg.norm(v, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    w = r.integers(1, 4, 260)
    members = spark.createDataFrame([(i, [float(y) for y in row], int(w[i]), 0, 260) for i, row in enumerate(v)], "id long, v array<double>, w long, component long, size long")
    got = {r["id"]: r["n"] for r in vectors._link_counts(members, 0.9).collect()}
    assert {i: got.get(i, 0) for i in range(260)} == {i: int((near[i] * w).sum()) for i in range(260)}


# the pipeline


def odd_docs(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "  ", base, base.upper(), base, base.replace("w30 ", "new "), "short one", "x" * 50_000, " ".join(f"v{i}" for i in range(20_000)), "short one"]
    rows = [(None if i == 2 else min(i, 9), t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_pipeline_stages_take_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_docs(spark)
    clash = docs.selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(("digest", "check", "n_bytes", "copies", "times", "rate", "node", "size", "component_id", "score", "held_out", "kept"))))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
        out = stage(spark, clash, "/root/testdata/sf0.001")
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == clash.columns and out.select(docs.columns).exceptAll(docs.withColumn("n_chars", F.col("n_chars"))).groupBy(docs.columns).count().where("doc_id is null").count() == 0, name
        assert out.count() > 0 or name == "quality classifier"


def test_pipeline_runs_as_composed(spark):
    """Each stage on its predecessor's rows, against plain Python."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf, stages = "/root/testdata/sf0.001", dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, labels).collect()}
    kept = {r["doc_id"]: r["text"] for r in stages["quality classifier"](spark, docs, sf).collect()}
    assert set(kept) == {i for i, y in scores.items() if y}
    frame = docs.where(F.col("doc_id").isin(list(kept)))
    by = defaultdict(list)
    for i, t in kept.items():
        by[t.encode().lower()].append(i)
    once = {r["doc_id"]: r["text"] for r in stages["exact dedup"](spark, frame, sf).collect()}
    assert set(once) == {max(x) for x in by.values()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in once.items()}
    low = {i: i for i in once}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(once)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    frame = docs.where(F.col("doc_id").isin(list(once)))
    apart = {r["doc_id"] for r in stages["n-gram Jaccard join"](spark, frame, sf).collect()}
    assert apart == {i for i in ids if root(i) == i}
    out = pipeline.run(spark, sf).collect()
    fill = defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["doc_id"] in apart
    for x in fill.values():
        assert sum(n for _, n in x) <= 4096 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))]
    json.dumps(len(out))
