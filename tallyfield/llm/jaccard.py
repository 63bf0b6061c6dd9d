"""Set-similarity join of documents on word n-grams: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, linked, shared_keys
from .shared import cut, filled, small, stash
from .shingles import Hashes, mixed, shingle_set
from .verify import verified_pairs

#: Shingles of a block in which repeats are looked for; entries of the table of frequent shingles.
BLOCK, FREQUENT = 4_000_000, 1_000_000


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that x holds several times, and how often; x is sorted in place, and nothing else of its size is made."""
    x.sort()
    same = np.r_[False, x[1:] == x[:-1], False] if len(x) else np.zeros(1, bool)
    first, end = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:]) + 1
    return x[first], end - first


def _repeats(docs: DataFrame, k: int) -> DataFrame:
    """(shingle, n): shingles that several documents of a block of a task hold, and in how many."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, held, size = Hashes(), [], 0

        def block():
            x = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            x, n = _counted(x)
            return pd.DataFrame({"shingle": x.view(np.int64), "n": n})

        for b in batches:
            for text in b["text"]:
                held.append(shingle_set(text, k, cache))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    size = 0
        yield block()

    return docs.select("text").mapInPandas(work, "shingle long, n long")


def frequent_shingles(docs: DataFrame, k: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles held most often, at most `most`, sorted, and their counts.

    Counts cover all documents but miss what is alone in its block of a task, so they rank, they
    don't measure. Any order that is the same for all documents gives right joins.
    """
    counts = stash(_repeats(docs, k).groupBy("shingle").agg(F.sum("n").alias("n")), "repeats")
    by_bits = {r["bits"]: r["rows"] for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("bits")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    least, rows = max(by_bits, default=0) + 1, 0
    for bits in sorted(by_bits, reverse=True):
        rows += by_bits[bits]
        if rows > most:
            break
        least = bits
    table = counts.where(F.floor(F.log2("n") * 4) >= least).toArrow()
    shingle, n = table["shingle"].to_numpy(), table["n"].to_numpy().astype(np.int32)
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _outline(x: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each of 2**j equal parts of the hash space, one part for eight hashes or fewer; empty if a count is over a byte."""
    bits = max(0, (len(x) - 1) // 8).bit_length()
    n = np.bincount((x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64), minlength=1 << bits)
    return b"" if n.max() > 255 else n.astype(np.uint8).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """At least so many hashes are in only one of the two sets: the sum over parts of the hash space of the differences of their counts."""
    if not x or not y:
        return 0
    x, y = (np.frombuffer(o, np.uint8).astype(np.int32) for o in (x, y))
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(n, -1).sum(axis=1) - y.reshape(n, -1).sum(axis=1)).sum())


def shingle_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, size, node, prefix, outline): per document its set's size and hash, its rarest shingles and its outline.

    Of equal sets in a task only the first has a prefix and an outline.

    A set of s shingles that overlaps another by the wanted share holds one of the other's prefix
    among its own s - ceil(s * percent / 100) + 1 rarest. outline: see _outline().
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen = Hashes(), set()
        known, n = sent.value
        for b in batches:
            out = []
            for text in b["text"]:
                x = shingle_set(text, k, cache)
                size = len(x)
                if not size:
                    out.append((0, 0, None, None))
                    continue
                node = _node(x)
                if node in seen:  # a copy adds nothing to the join
                    out.append((size, node, None, None))
                    continue
                seen.add(node)
                signed = x.view(np.int64)
                at = np.searchsorted(known, signed)
                at[at == len(known)] = 0
                held = np.where(known[at] == signed, n[at], 0) if len(known) else np.zeros(size, np.int64)
                prefix = signed[np.argsort(held, kind="stable")[: size - -(-size * percent // 100) + 1]]  # ties: by hash
                out.append((size, node, prefix, _outline(x)))
            sets = pd.DataFrame(out, columns=["size", "node", "prefix", "outline"], index=b.index)
            yield pd.concat([b[["doc_id", "unknown"]], sets], axis=1)

    rows = docs.select(filled("doc_id"), F.col("doc_id").isNull().alias("unknown"), "text").mapInPandas(work, "doc_id long, unknown boolean, size int, node long, prefix array<long>, outline binary")
    return rows.withColumn("doc_id", F.when(~F.col("unknown"), F.col("doc_id"))).drop("unknown")


def _node(x: np.ndarray) -> int:
    """A hash of a set of hashes and of its size."""
    return int((np.bitwise_xor.reduce(mixed(x * np.uint64(0x9E3779B97F4A7C15))) ^ mixed(np.array([len(x)], np.uint64))[0]).view(np.int64))


def similar_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are what [^\\x20\\x09-\\x0D]+ matches after lower-casing A-Z; a document's set holds its
    distinct k-word shingles (fewer words: the whole sequence as one; none: empty, linked with
    nothing). Documents link when 100 * |intersection| >= percent * |union|; component_id is the
    smallest doc_id reachable by links, itself included.

    Equal sets are one node. Nodes meet on the rarest shingles of their sets, frequent ones last;
    pairs pass the length filter and the positional filter at the join. The suffix filter then runs
    over the whole sets instead of what follows the match alone: both are partitioned alike, in
    parts of about eight shingles, and the differences of the parts' counts add up to a lower bound
    of the sets' difference. What is left is verified once by the sets themselves, read again from
    the documents. Nodes that an earlier verified link already connects are not paired again.
    Shingles and nodes are 64-bit hashes. Null text has no words; documents with a null doc_id link
    like others, and a component's smallest doc_id is that of its known ones (null if it has none);
    repeated rows come back as they are. Long texts cost memory in proportion. Other columns are not
    read. An empty table gives no rows.
    """
    sets = stash(shingle_sets(docs, k, percent), "sets")
    node = sets.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("outline").alias("outline"))
    node = stash(node, "nodes")
    keys = sets.where("size > 0").select("node", F.col("size").cast("long").alias("size"), F.posexplode("prefix").alias("pos", "key"))
    keys = keys.select("key", "node", "size", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("int").alias("sketch"))

    def least_overlap(x, y):
        """Smallest intersection of linking sets: i >= p / 100 * (x + y - i)."""
        return F.ceil(percent * (x.getField("size") + y.getField("size")) / F.lit(100.0 + percent) - 1e-9)

    def fits(x, y):
        xs, ys = x.getField("size"), y.getField("size")
        after = F.least(xs - x.getField("pos"), ys - y.getField("pos"))  # this shingle and those behind it
        return (xs * 100 >= ys * percent) & (ys * 100 >= xs * percent) & (after >= least_overlap(x, y))

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            apart = np.array([_apart(x, y) for x, y in zip(d["x"], d["y"], strict=True)], np.int64)
            keep = apart * (100 + percent) <= (d["size_a"] + d["size_b"]).to_numpy() * (100 - percent)
            yield d.loc[keep, ["a", "b", "doc_a", "doc_b", "place_a", "place_b"]]

    def own_sets():
        cache = Hashes()

        def find(text: str, wanted: dict[int, int]) -> dict[int, np.ndarray]:
            x = shingle_set(text, k, cache)
            return {_node(x): x} if len(x) else {}

        return find

    def verified(pairs: DataFrame) -> DataFrame:
        info = node.select("node", "size", filled("doc_id"), "outline")
        a, b = (info.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("doc_id").alias(f"doc_{s}"), F.lit(0).cast("long").alias(f"place_{s}"), F.col("outline").alias(o)) for s, o in (("a", "x"), ("b", "y")))
        both = pairs.join(a, "a").join(b, "b").mapInPandas(alike, "a long, b long, doc_a long, doc_b long, place_a long, place_b long")
        return verified_pairs(cut(both), docs, own_sets, percent)

    label = components(linked(shared_keys(keys), verified, fits))
    label = label.join(node.select(F.col("node").alias("id"), "doc_id"), "id")
    least = label.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = label.join(least, "component").select(F.col("id").alias("node"), "least")
    named = stash(node.select("node", "doc_id").join(named, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id")).where("component_id is not null"), "named")
    out = sets.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("node")).alias("node"))
    return out.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """docs without those whose component has a smaller doc_id, with all their columns.

    Of rows that repeat a doc_id that stays all stay, and so do rows with a null doc_id, as no id
    tells which of them to drop. Texts without words stay; an empty table stays empty. See similar_documents() for the rest.
    """
    drop = stash(similar_documents(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct(), "similar")
    return docs.join(small(drop), "doc_id", "left_anti").select(docs.columns)
