"""Exact verification of candidate pairs whose sets are read again from the documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, filled, small, text_parts

#: Partners that a set is compared with in one group; a set with more is sent to several groups.
SPREAD = 256


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified_pairs(pairs: DataFrame, docs: DataFrame, sets: Callable[[], Callable[[str, dict[int, int]], dict[int, np.ndarray]]], percent: int) -> DataFrame:
    """(a, b) of those pairs whose sets' Jaccard similarity is percent / 100 or more.

    pairs: distinct (a, b, doc_a, doc_b, place_a, place_b), cheap to read again, with a document
    (NO_ID for a null id) that holds each node and a number that says where; sets() gives a task's
    function of a text and {node: place}: the sets of those nodes that the text has there, as sorted
    distinct hashes.

    Each pair belongs to the end with more pairs. An end's set and those of up to SPREAD partners
    make up a group, so a set moves once for each group, not once for each pair, and a group is read
    in order with one set held at a time. Rows that repeat a doc_id with another text are passed over.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree = cut(ends.groupBy("node").agg(F.count(F.lit(1)).alias("pairs")))
    a, b = (degree.select(F.col("node").alias(s), F.col("pairs").alias(f"pairs_{s}")) for s in "ab")
    both = pairs.join(small(a), "a").join(small(b), "b")
    first = F.col("pairs_a") >= F.col("pairs_b")
    end = lambda c, s: F.col(f"{c}_{s}") if c else F.col(s)
    own = lambda c: F.when(first, end(c, "a")).otherwise(end(c, "b"))
    other = lambda c: F.when(first, end(c, "b")).otherwise(end(c, "a"))
    owned = both.select(own("").alias("owner"), own("doc").alias("own_doc"), other("").alias("node"), other("doc").alias("at"), other("place").alias("place"), own("place").alias("own_place"), own("pairs").alias("pairs"))
    owned = owned.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("pairs") / SPREAD))).drop("pairs")
    leads = owned.select("owner", "block", F.col("owner").alias("node"), F.col("own_doc").alias("at"), F.col("own_place").alias("place"), F.lit(True).alias("lead")).distinct()
    wanted = cut(owned.select("owner", "block", "node", "at", "place", F.lit(False).alias("lead")).unionByName(leads))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sets()
        for b in batches:
            for part, texts in text_parts(b):
                found: list[bytes | None] = []
                rows = zip(texts, part["node"].to_pylist(), part["place"].to_pylist(), strict=True)
                for text, own in groupby(rows, itemgetter(0)):
                    wanted = [(node, place) for _, node, place in own]
                    held = find(text, dict(wanted))
                    found += (held[node].tobytes() if node in held else None for node, _ in wanted)
                out = pa.RecordBatch.from_arrays([*(part[c] for c in ("owner", "block", "lead", "node")), pa.array(found, pa.binary())], names=["owner", "block", "lead", "node", "shingles"])
                yield out.filter(out["shingles"].is_valid())

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (owner, block, lead, x) in enumerate(zip(b["owner"], b["block"], b["lead"], b["shingles"], strict=True)):
                if lead:
                    at, own = (owner, block), np.frombuffer(x, np.uint64)
                elif at != (owner, block):
                    raise ValueError(f"no document holds the set {owner}")
                else:
                    keep[i] = _alike(own, np.frombuffer(x, np.uint64), percent)
            d = b.loc[keep]
            yield pd.DataFrame({"a": np.minimum(d["owner"], d["node"]), "b": np.maximum(d["owner"], d["node"])})

    rows = docs.select(filled("doc_id").alias("at"), "text").where("text is not null").join(small(wanted), "at")
    rows = rows.mapInArrow(fetch, "owner long, block long, lead boolean, node long, shingles binary")
    dealt = rows.repartition("owner", "block").sortWithinPartitions("owner", "block", F.desc("lead"))
    return dealt.mapInPandas(check, "a long, b long")
