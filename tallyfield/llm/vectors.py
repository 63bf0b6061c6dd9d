"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, stash

#: Random hyperplanes whose signs make up a sort key; rows of a sorted partition; vectors of a block when links are counted.
BITS, ROWS, BLOCK = 48, 100_000, 1024
#: Enough for millions of vectors: a pass meets an isolated pair the less often the more vectors there are.
PASSES, WINDOW = 64, 64


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # else squares of very small or large components vanish or overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


class _Sets(dict):
    """Union-find over ids: joined(a, b) is whether the two were still apart."""

    def root(self, x):
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def joined(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self[b] = a
        return a != b


def _neighbours(d: pd.DataFrame, window: int, least: float, new_from: int, sets: _Sets) -> list[tuple[int, int]]:
    """Verified links of rows at most `window` places apart in one pass, of which the later is at new_from or behind; those that a chain of others already gives are left out."""
    if len(d) < 2:
        return []
    x, ids, turn = _unit(d["v"]), d["id"].to_numpy(), d["turn"].to_numpy()
    out = []
    for o in range(1, min(window, len(d) - 1) + 1):
        low = max(0, new_from - o)
        near = (np.einsum("ij,ij->i", x[low:-o], x[low + o :]) >= least) & (turn[low:-o] == turn[low + o :])
        for i in np.flatnonzero(near) + low:
            a, b = int(ids[i]), int(ids[i + o])
            if a != b and sets.joined(a, b):
                out.append((min(a, b), max(a, b)))
    return out


def near_links(classes: DataFrame, least: float, passes: int, window: int, seed: int = 5) -> DataFrame:
    """Verified links (a, b) that connect what the passes find; classes: (id, v) of distinct vectors of one length.

    In each pass a vector's key is the signs of its projections on the pass's own random
    hyperplanes, one after another. All passes are sorted at once, by (pass, key); a task runs over
    its sorted rows with a window, and the ends of neighbouring partitions are compared afterwards.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _unit(b["v"])
            for turn in range(passes):
                planes = np.random.default_rng([seed, turn, x.shape[1]]).normal(size=(x.shape[1], BITS))
                yield pd.DataFrame({"turn": turn, "key": (x @ planes > 0) @ (1 << np.arange(BITS)[::-1]), "id": b["id"], "v": b["v"]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tail, sets, first = TaskContext.get().partitionId(), None, _Sets(), 0
        for b in batches:
            if not len(b):
                continue
            if first < window:
                head = b.iloc[: window - first]
                yield pd.DataFrame({"edge": at, "place": np.arange(first, first + len(head)), "turn": head["turn"], "id": head["id"], "v": head["v"]})
                first += len(head)
            d = b if tail is None else pd.concat([tail, b], ignore_index=True)
            links = _neighbours(d, window, least, 0 if tail is None else len(tail), sets)
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
            tail = d.iloc[-window:]
        if tail is not None:
            yield pd.DataFrame({"edge": at + 1, "place": np.arange(-len(tail), 0), "turn": tail["turn"], "id": tail["id"], "v": tail["v"]})

    def whole(f, columns=("edge", "place", "turn", "id", "v", "a", "b")):
        def run(batches):
            for d in f(batches):
                none = pd.Series([None] * len(d), dtype=object, index=d.index)
                yield pd.DataFrame({c: d[c] if c in d else none for c in columns}).astype({c: "Int64" for c in columns if c != "v"})

        return run

    kind = classes.schema["v"].dataType.simpleString()
    rows = classes.mapInPandas(keyed, f"turn int, key long, id long, v {kind}")
    parts = max(1, -(-classes.count() * passes // ROWS))
    ordered = rows.repartitionByRange(parts, "turn", "key", "id").sortWithinPartitions("turn", "key", "id")
    found = stash(ordered.mapInPandas(whole(scan), f"edge long, place long, turn long, id long, v {kind}, a long, b long"), "scanned")

    def seam(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("place", kind="stable", ignore_index=True)
        return pd.DataFrame(_neighbours(d, window, least, int((d["place"] < 0).sum()), _Sets()), columns=["a", "b"], dtype="int64")

    seams = found.where("edge is not null").groupBy("edge").applyInPandas(seam, "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(seams).distinct()


def _link_counts(members: DataFrame, least: float) -> DataFrame:
    """(id, n): for members(id, v, w, component, size) the total w of the other members at cosine >= least.

    Angles obey the triangle inequality: two members whose angles to the component's first vector
    are each at most half the linking angle link for sure, so such core members are counted, not
    compared with each other. All pairs with another member are compared: a component over BLOCK is
    cut into blocks of core and of other members, and each pair of blocks is one small task; small
    components share a task and are compared whole.
    """
    half = (math.acos(least) - 1e-6) / 2
    first = members.where("id = component").select("component", F.col("v").alias("first"))
    kind = members.schema["v"].dataType.simpleString()

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                near = np.einsum("ij,ij->i", _unit(d["v"]), _unit(d["first"])) >= math.cos(half)
                yield d.drop(columns="first").assign(core=near)

    large = members.where(F.col("size") > BLOCK).join(first, "component").select("id", "v", "w", "component", "first")
    large = cut(large.mapInPandas(halves, f"id long, v {kind}, w long, component long, core boolean"))
    parts = large.groupBy("component").agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("others"), F.sum(F.when(F.col("core"), F.col("w"))).alias("core_w"))
    counted = large.where("core").join(parts, "component").select("id", (F.col("core_w") - F.col("w")).alias("n"))

    rows = large.join(parts, "component").withColumn("core_blocks", F.ceil(F.col("cores") / BLOCK)).withColumn("blocks", F.ceil(F.col("others") / BLOCK)).where("blocks > 0")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("core"), F.col("core_blocks")).otherwise(F.col("blocks"))))
    number = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    with_cores = F.transform(number(F.col("core_blocks")), lambda b: F.concat_ws("-", F.lit("c"), "component", "block", b))
    with_others = F.transform(number(F.col("blocks")), lambda b: F.concat_ws("-", F.lit("o"), "component", F.least("block", b), F.greatest("block", b)))
    of_core = F.transform(number(F.col("blocks")), lambda b: F.concat_ws("-", F.lit("c"), "component", b, "block"))
    cross = rows.withColumn("task", F.explode(F.when(F.col("core"), of_core).otherwise(F.concat(with_cores, with_others))))
    cross = cross.withColumn("side", F.when(F.col("core"), -1).otherwise(F.col("block")))
    share = max(1, -(-members.count() // BLOCK))
    alone = members.where(F.col("size") <= BLOCK).withColumn("side", F.lit(0).cast("long")).withColumn("task", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(share))))

    def count(d: pd.DataFrame) -> pd.DataFrame:
        x, c, w, side = _unit(d["v"]), d["component"].to_numpy(), d["w"].to_numpy(), d["side"].to_numpy()
        one = side == side.min()
        if one.all():
            sides = [] if side[0] < 0 else [(np.arange(len(d)), np.arange(len(d)))]
        else:
            sides = [(np.flatnonzero(one), np.flatnonzero(~one)), (np.flatnonzero(~one), np.flatnonzero(one))]
        n = np.zeros(len(d), np.int64)
        for i, j in sides:
            near = (x[i] @ x[j].T >= least) & (c[i][:, None] == c[j])
            near &= i[:, None] != j
            n[i] += near @ w[j]
        return pd.DataFrame({"id": d["id"], "n": n})

    columns = ["id", "v", "w", "component", "side", "task"]
    compared = alone.select(columns).unionByName(cross.select(columns)).groupBy("task").applyInPandas(count, "id long, n long")
    return compared.unionByName(counted).groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(embeddings: DataFrame, least: float = 0.9, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors link at a cosine (double precision) of `least` or more; no link is below it. Sorted
    passes with bounded windows find verified pairs, whose union gives the components; then every
    component's links are counted exactly, so that a window does not cap a large group's counts.
    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths or rows without a vec_id. Equal vectors are one class and linked;
    of rows that repeat a vec_id the smallest vector stands for all. Other columns, whatever their
    names, are not read. An empty table gives no rows.
    The chance that a pair is met grows with the passes and the window and falls as
    the table grows: README.md has the recall by table size.
    """
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select("vec_id", F.col("embedding").alias("v"))
    vectors = stash(rows.where(good & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    classes = stash(vectors.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")), "classes")
    links = None
    for n in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        found = near_links(classes.where(F.size("v") == n).select("id", "v"), least, passes, window)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    label = components(links)
    size = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = cut(classes.join(label, "id").join(size, "component").select("id", "v", "w", "component", "size"))
    per_class = classes.select("id", "v", "w").join(_link_counts(members, least), "id", "left").join(label, "id", "left")
    per_class = per_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    named = stash(vectors.join(per_class, "v").select("vec_id", "n_links", "component_id"), "named")
    out = rows.select("vec_id").join(named, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
