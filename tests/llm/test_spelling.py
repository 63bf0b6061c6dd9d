"""Spelling variants against brute force over all pairs, and against SQL."""

import re
import zlib
from collections import Counter

import duckdb
import pytest
from tallyfield.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n string, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    form, count = {}, {}
    for w in n:
        ends = {w[:i] + w[i + 1 :] for i in range(len(w))}
        others = [x for x in n if abs(len(x) - len(w)) <= 1 and x != w and (len(x) != len(w) - 1 or x in ends) and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = best if best and n[best] >= 10 * n[w] else None, len(others)
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted((w, form[w], root[w], n[w], count[w], n[form[w]] if form[w] else None) for w in n)


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("subtree", [1_000_000, 40, 1])
def test_chains_ties_and_levels(spark, monkeypatch, subtree):
    monkeypatch.setattr(spelling, "SUBTREE", subtree)
    base = "colours " * 300 + "colour's " + "colourz " * 30 + "colourzz " * 3 + "couloursx " * 2 + "COLOURZy " * 2 + "ÉTÉnuage " * 40 + "étÉnuage " * 4 + "éténuage " * 2 + "abcdefgh abcdefhg bacdefgh " * 2
    rows = [(i, base) for i in range(3)] + [(i, f"w{'x' * (i % 5)}ordlike{chr(97 + i % 26)} " * 2) for i in range(60)]
    rows += [(None, "nullish nullish nullish"), (7, None), (8, ""), (9, "y" * 200_000 + " " + "y" * 200_000), (9, "y" * 199_999 + "z"), (9, "y" * 199_999 + "z"), (9, "7éöØ×÷abc " * 3)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    want = brute(rows)
    assert result(spelling.spelling_variants(df)) == want
    assert len({r[2] for r in want}) > 3 and any(r[1] and r[1] != r[2] for r in want)
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = result(queries.queries()["op13_spelling"](spark, sf))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = duck.execute(f"select word, form, root, n, n_near, form_n from ({queries.oracle_sql()['op13_spelling']})").fetchall()
    assert sorted(sql) == got
