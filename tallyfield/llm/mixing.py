"""Mixing documents to target domain weights by soft membership, with DataFrame functions only."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh, small, stash

#: Token shares wanted of each domain, in the order of the posteriors.
TARGETS = {"plain": 0.90, "rough": 0.06, "toxic": 0.04}
#: Cells that words are hashed into; words that weigh fully in a document's evidence.
CELLS, EVIDENCE = 4096, 40.0


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels(doc_id, quality, toxic): toxic, else plain or rough by quality; rows without labels go."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "plain").when(F.col("quality") == 0, "rough")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _words() -> Column:
    return F.filter(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _cells(words: Column) -> Column:
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(CELLS)) + 1).cast("int"))


def word_evidence(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 200_000) -> tuple[list[list[float]], list[float]]:
    """A naive Bayes table from labelled documents: for each domain but the first, log odds of every cell against the first, and of the domain.

    At most `sample` labelled documents take part, chosen by a hash of doc_id, so that the labels can
    be broadcast; what comes to the driver is one number for each domain and cell.
    """
    chosen = labelled.where(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = rows.select("domain", F.explode(_cells(_words())).alias("cell")).groupBy("domain", "cell").agg(F.count(F.lit(1)).alias("n"))
    n = {(r["domain"], r["cell"]): r["n"] for r in counted.collect()}
    docs_of = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {d: sum(n.get((d, c), 0) for c in range(1, CELLS + 1)) for d in domains}
    logp = {d: [math.log((n.get((d, c), 0) + 0.5) / (total[d] + 0.5 * CELLS)) for c in range(1, CELLS + 1)] for d in domains}
    prior = {d: math.log(docs_of.get(d, 0) + 0.5) for d in domains}
    first = domains[0]
    return [[round(x - y, 5) for x, y in zip(logp[d], logp[first], strict=True)] for d in domains[1:]], [prior[d] - prior[first] for d in domains[1:]]


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 200_000) -> DataFrame:
    """docs(doc_id, ...) with n_tokens and p_<domain>, posteriors rounded to hundredths that add up to 1."""
    odds, prior = word_evidence(docs, labelled, domains, sample)
    rows = docs.select("doc_id", _cells(_words()).alias("cells"))
    table = [F.from_json(F.lit(json.dumps(o)), "array<double>") for o in odds]
    weight = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size("cells"), F.lit(1)))

    def summed(odds_of: Column) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda s, c: s + F.element_at(odds_of, c))

    scores = [summed(t) * weight + F.lit(p) for t, p in zip(table, prior, strict=True)]
    rows = rows.select("doc_id", F.size("cells").cast("long").alias("n_tokens"), *(s.alias(f"s{i}") for i, s in enumerate(scores)))
    top = F.greatest(F.lit(0.0), *(F.col(f"s{i}") for i in range(len(scores))), F.lit(-1e9))
    e = [F.exp(-top), *(F.exp(F.col(f"s{i}") - top) for i in range(len(scores)))]
    total = sum(e[1:], e[0])
    rest = [F.floor(x / total * 100 + 0.5) / 100 for x in e[1:]]
    return rows.select("doc_id", "n_tokens", F.greatest(F.lit(0.0), F.round(F.lit(1.0) - sum(rest[1:], rest[0]), 2)).alias(f"p_{domains[0]}"), *(r.alias(f"p_{d}") for r, d in zip(rest, domains[1:], strict=True)))


def fitted_rate(member: DataFrame, targets: dict[str, float], steps: int = 40, close: float = 1e-6) -> Column:
    """The rate of a document as an expression over its posteriors, such that the domains' expected token totals match.

    Projected gradient, over rates >= 0 and from rate 1, on half the squared distance of the domains'
    totals from their targets, measured in the metric of the inverse second moments of the
    posteriors: a unit step is then the longest safe one. A document's gradient is taken per token,
    so a rate depends on the posteriors alone and the steps run over the distinct posteriors' token
    sums, not over documents. Each step is one aggregation that gives one number a domain.
    """
    p = [F.col(f"p_{d}") for d in targets]
    cells = stash(member.groupBy(*p).agg(F.sum("n_tokens").alias("n")), "cells")
    k = len(p)
    row = cells.agg(F.sum("n"), *(F.sum(F.col("n") * x * y) for x in p for y in p)).first()
    whole = float(row[0] or 0)
    want = np.array(list(targets.values()), float) / sum(targets.values())
    rate = F.lit(1.0)
    if not whole:
        return rate
    moments = np.linalg.pinv(np.array(row[1:], float).reshape(k, k) / whole, rcond=1e-9)
    for _ in range(steps):
        got = cells.select(*(F.sum(F.col("n") * x * rate) for x in p)).first()
        off = np.array([float(g or 0) for g in got]) / whole - want
        pull = moments @ off
        if np.abs(pull).max() < close:
            break
        rate = F.greatest(F.lit(0.0), rate - sum((x * F.lit(float(q)) for x, q in zip(p, pull, strict=True)), F.lit(0.0)))
    return rate


def mixed_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, sample: int = 200_000) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, p_<domain>..., rate, copies.

    labelled: (doc_id, domain). A classifier learned from it gives each document's domain posteriors
    from its words; rates >= 0 are fitted so that the domains' expected token totals
    (rate x tokens x posterior) are in proportion to `targets` at the same overall total. copies is
    the rate rounded down or up by a hash of doc_id, so that rates hold on average. A domain without
    labelled documents or tokens keeps what can be reached. Null text counts as empty (no tokens,
    prior posteriors); a null doc_id is hashed like any other value; repeated rows get equal rates;
    long texts are counted whole; columns of docs other than doc_id and text are not read, whatever
    their names; an empty table gives no rows. n_tokens counts white-space words.
    """
    member = stash(memberships(docs, labelled, list(targets), sample), "members")
    rate = F.round(fitted_rate(member, targets), 6)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return member.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs(doc_id, text, lang, source, n_chars) with every row as often as mixed_rates() says, some not at all.

    Rows that repeat a doc_id come as often as the largest of their rates says; a null doc_id comes
    once. Null and empty texts have no tokens and the rate of the prior; other columns, whatever
    their names, come along; an empty table stays empty.
    """
    times = fresh("times", docs.columns)
    copies = mixed_rates(docs, labelled, targets).groupBy("doc_id").agg(F.max("copies").alias(times))
    copies = stash(copies.where(F.col(times) != 1), "copies")
    rows = docs.join(small(copies), "doc_id", "left").withColumn(times, F.coalesce(times, F.lit(1))).where(F.col(times) > 0)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)
