"""Connected components of link tables, and components of what shares a key without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, cut, discard, small, stash

#: Edges of a task: a table of links is read in as many parts as it needs, whatever the number of shuffle partitions.
EDGES = 200_000
#: A key with so many postings is not gathered in one task; so many of the most frequent keys are looked at, by a sketch of so many items.
HOT, HOT_KEYS, SKETCH = 1000, 1000, 20_000
#: Postings of a key in several components that are paired without a closer look.
CROWD = 256
#: Sketches of tasks that are merged at a time.
FAN = 8


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge (a, b): component is the smallest id reachable.

    Alternates large-star and small-star steps until the edge set stands still; each step is a
    grouped minimum (pre-aggregated before its shuffle) and an equi-join, and each round is
    checkpointed. Null ends and loops are ignored; without edges the result is empty.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    edges = edges.coalesce(max(1, -(-mark[0] // EDGES)))
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        nodes = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(nodes.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        was, edges, mark = mark, after, _mark(after)
        if mark == was:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def hot_keys(postings: DataFrame, most: int = HOT_KEYS, sketch: int = SKETCH) -> list[int]:
    """The keys that about HOT postings or more have, of the `most` most frequent ones, by mergeable bounded sketches.

    The tasks' sketches meet in a tree of three levels, so that none merges those of all tasks. What
    the sketch gets wrong costs speed alone: a key that is missed is gathered like any other.
    """
    level = postings.select(F.spark_partition_id().alias("part"), "key").groupBy((F.col("part") % FAN**2).alias("part")).agg(F.expr(f"approx_top_k_accumulate(key, {sketch})").alias("s"))
    for fan in (FAN, 1):
        level = level.groupBy((F.col("part") % fan).alias("part")).agg(F.expr(f"approx_top_k_combine(s, {sketch})").alias("s"))
    got = level.select(F.expr(f"approx_top_k_estimate(s, {most})").alias("top")).first()
    if not got:
        return []
    return [x["item"] for x in got["top"] or [] if x["count"] >= HOT]


def shared_keys(postings: DataFrame, alone: bool = False) -> DataFrame:
    """(key, me, hub, n): the distinct postings of every key that several nodes have, its most central one, and how often each came.

    postings: (key, node, size, pos, sketch), cheap to read twice; me and hub are structs of the last
    four. The hub of a key has the smallest pos, then the most postings. With `alone` also postings
    that came several times stay, whatever else their key has. Postings are dealt by key once; those
    of hot keys are dealt by key and node instead, and meet their hub by a broadcast of at most
    HOT_KEYS rows.
    """
    me = F.struct("pos", "node", "size", "sketch").alias("me")
    central = F.struct("me.pos", (-F.col("n")).alias("rare"), "me")
    columns = ["key", "me", "hub", "n"]
    hot = hot_keys(postings)
    key = Window.partitionBy("key")
    several = (F.col("low") < F.col("high")) | (F.col("n") > 1) if alone else F.col("low") < F.col("high")
    cold = postings.where(~F.col("key").isin(hot)) if hot else postings
    cold = cold.repartition("key").withColumn("low", F.min("node").over(key)).withColumn("high", F.max("node").over(key)).withColumn("n", F.count(F.lit(1)).over(key))
    cold = cold.where(several).groupBy("key", "low", "high", me).agg(F.count(F.lit(1)).alias("n"))  # most keys are gone by now
    out = cold.withColumn("hub", F.min(central).over(key)["me"]).where(several).select(columns)
    if hot:
        held = cut(postings.where(F.col("key").isin(hot)).groupBy("key", me).agg(F.count(F.lit(1)).alias("n")))
        hubs = held.groupBy("key").agg(F.min(central)["me"].alias("hub"), F.min("me.node").alias("low"), F.max("me.node").alias("high"))
        out = out.unionByName(held.join(F.broadcast(hubs), "key").where(several).select(columns))
    return stash(out, "shared")


def linked(shared: DataFrame, verified: Callable[[DataFrame], DataFrame], fits: Callable[[Column, Column], Column], wide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b) links that connect all that any pair sharing a key would connect.

    shared: see shared_keys(); verified: keeps the pairs (a, b) that do link; fits: a condition on
    the two postings (struct columns) that every linking pair meets at one of its keys. First every
    node is tried against the hub that it meets on the most keys. Only keys whose nodes then still
    lie in several components give further pairs, and of those only the pairs across components:
    every other pair could not change a component. A key with up to CROWD such postings gives at most
    CROWD / 2 pairs for each; for keys with more, wide(nodes) gives (node, wide) of the nodes that take
    part, for fits to look at (it is null for others), and their joins are plain shuffled joins, whose
    skewed partitions Spark splits.
    """
    shared = shared.withColumns({c: F.col(c).withField("wide", F.lit(None).cast("array<long>")) for c in ("me", "hub")})
    near = shared.where((F.col("me.node") != F.col("hub.node")) & fits(F.col("me"), F.col("hub"))).groupBy("me.node", F.col("hub.node").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    best = near.groupBy("node").agg(F.max(F.struct("n", "to")).alias("best"))
    tried = cut(best.select(F.least("node", "best.to").alias("a"), F.greatest("node", "best.to").alias("b")).distinct())
    links = cut(verified(tried))
    label = small(cut(components(links)).withColumnRenamed("id", "node"))
    part = shared.select("key", "me", F.col("me.node").alias("node")).join(label, "node", "left").select("key", "me", F.coalesce("component", "node").alias("part"))
    parts = part.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", (F.col("n") > CROWD).alias("crowded"))
    part = stash(part.join(parts, "key"), "open")

    def across(rows: DataFrame) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")) & fits(F.col("x.me"), F.col("y.me"))
        return x.join(y, on).select(F.least("x.me.node", "y.me.node").alias("a"), F.greatest("x.me.node", "y.me.node").alias("b"))

    if wide:
        crowd = part.where("crowded")
        own = stash(wide(cut(crowd.select("me.node").distinct())), "wide")
        crowd = stash(crowd.withColumn("node", F.col("me.node")).join(small(own, BROADCAST_ROWS // 8), "node", "left").select("key", F.col("me").withField("wide", F.col("wide")).alias("me"), "part"), "crowd")
        rest = across(part.where("not crowded")).unionByName(across(crowd)).distinct()
    else:
        rest = across(part).distinct()
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"))
    discard(part, *([own, crowd] if wide else []))
    return links.unionByName(cut(verified(rest)))
