"""The prefix trie of conversations against a brute-force trie, and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from tallyfield.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()


def brute(rows, heads=6, family=100):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, said in own.items():
        h, base = zlib.crc32(str(c).encode()) % heads, c - (abs(c) % family) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + said[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].add(c)
        ends[tuple(rebuilt[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    )


def result(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def random_rows(seed, n=70, longest=9):
    r = random.Random(seed)
    says = [("user", "hi"), ("assistant", "hello there"), (None, None), ("user", ""), ("", "naïve 🎈"), ("user", "hi" * 50)]
    rows = []
    for c in r.sample(range(-150, 420), n) + [0, 100, 200]:
        for t in range(r.choice([1, 2, 3, 5, longest])):
            rows.append((c, r.choice([t, t, t, None, 3]), *r.choice(says[: r.choice([1, 2, 6])])))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "MANY", 2 if seed == 1 else 1000)
    rows = random_rows(seed)
    assert result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_odd_rows(spark):
    edge = 2**63 - 1
    rows = [(None, 1, "user", "lost"), (edge, 0, "user", "a"), (edge, 0, "user", "a"), (-(2**63), None, None, None), (5, 1, "user", "x" * 300_000), (7, 1, "user", "x" * 300_000), (7, 2, "b", "y")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA + ", seq string, depth int")
    assert result(trie.prefix_trie(df)) == brute(rows)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_whole_table_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = result(queries.queries()["op11_prefix_trie"](spark, sf))
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert sorted(duck.execute(f"select {names} from ({queries.oracle_sql()['op11_prefix_trie']})").fetchall()) == got
