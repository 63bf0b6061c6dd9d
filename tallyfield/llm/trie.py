"""The prefix trie of conversations, by collapsing whole sequences before their prefixes are counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, small, stash

#: Neighbouring turns that one task keeps together; a longer conversation is spread over several.
BLOCK = 1024
#: A node with so many children meets them by a broadcast, so that they are not gathered in one task.
MANY = 1000

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, said, chars) of every turn: what was said stands as its SHA-256 and its length, so no text is shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256)).alias("said")
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said, F.char_length(text).cast("long").alias("chars"))


def placed_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, place, said, chars) of every turn and (conv_id, part, before, size): turns numbered in order, in parts.

    Turns are dealt by ranges of (conv_id, turn), so a long conversation lies in several parts;
    place counts from 0 inside a part, before is what the parts ahead of it hold, size what all do.
    Null turns come first; equal turn numbers go by the digest of role and text, where equal digests
    are equal turns.
    """
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("said").asc()]
    dealt = scratch.stash(_turns(conversations).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    turns = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order[1:])) - 1).drop("turn")
    parts = Window.partitionBy("conv_id")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    spots = counts.select("conv_id", "part", (F.sum("n").over(parts.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(parts).alias("size"))
    return turns, scratch.stash(spots, "spots")


def rebuilt_turns(conversations: DataFrame, scratch: Scratch, heads: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, said, chars) of every rebuilt conversation, and (conv_id) of all, turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % family (all, if it has
    fewer; none, if it is absent) and goes on with its own turns behind its first h; h is the
    unsigned crc32 of c as text, modulo `heads`.
    """
    turns, spots = placed_turns(conversations, scratch)
    h = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % heads).cast("long")
    first = spots.where("before = 0").select("conv_id", F.least("size", F.lit(heads)).alias("size"))
    base = F.col("conv_id") - F.col("conv_id") % family
    bases = first.where(F.col("conv_id") % family == 0)
    lent = F.least(h("conv_id"), F.coalesce("lent", F.lit(0)))  # how many turns the base gives
    shifts = spots.withColumn("base", base).join(bases.select(F.col("conv_id").alias("base"), F.col("size").alias("lent")), "base", "left")
    shifts = shifts.select("conv_id", "part", "before", (lent - h("conv_id")).alias("shift"))
    own = turns.join(shifts, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("place")).where(F.col("pos") >= h("conv_id"))
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "said", "chars")
    ahead = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < heads)).join(spots, ["conv_id", "part"])
    ahead = ahead.select(F.col("conv_id").alias("base"), (F.col("before") + F.col("place")).alias("pos"), "said", "chars").where(F.col("pos") < heads - 1)
    given = first.select("conv_id", base.alias("base")).join(ahead, "base").where(F.col("pos") < h("conv_id")).select("conv_id", "pos", "said", "chars")
    return own.unionByName(given), first.select("conv_id")


def _xor(*names: str) -> list[Column]:
    return [F.expr(f"bit_xor({n})").alias(n) for n in names]


def _prefixes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, block, depth, x, y, px, py, chars) of every prefix, and (conv_id, x, y, depth) of every whole sequence.

    (x, y) is the exclusive or of two independent 64-bit hashes of (pos, said) over the prefix, so
    it can be summed up in blocks; with depth it stands for the prefix. (px, py) is one turn shorter.
    """
    said = rows.select(
        "conv_id", (F.col("pos") / BLOCK).cast("long").alias("block"), "pos", "chars",
        F.xxhash64("pos", "said").alias("dx"), F.xxhash64(F.lit("second"), "said", "pos").alias("dy"),
    )
    said = scratch.stash(said, "said")
    blocks = said.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("depth"), F.expr("bit_xor(dx)").alias("x"), F.expr("bit_xor(dy)").alias("y"))
    whole = blocks.groupBy("conv_id").agg(*_xor("x", "y"), F.sum("depth").alias("depth"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *(F.coalesce(F.expr(f"bit_xor({c})").over(ahead), F.lit(0)).alias(f"c{c}") for c in "xy"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos")
    run = said.select("*", *(F.expr(f"bit_xor(d{c})").over(inside).alias(f"r{c}") for c in "xy")).join(carried, ["conv_id", "block"])
    x, y = (F.col(f"r{c}").bitwiseXOR(F.col(f"c{c}")) for c in "xy")
    px, py = x.bitwiseXOR(F.col("dx")), y.bitwiseXOR(F.col("dy"))
    return run.select("conv_id", "block", (F.col("pos") + 1).alias("depth"), x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"), "chars"), whole


def sequences(conversations: DataFrame, scratch: Scratch, heads: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole sequences collapsed: (seq, x, y, depth, weight), members (seq's key, conv_id), and the prefixes of one conversation of each.

    seq is the smallest conv_id of those whose rebuilt conversations are identical.
    """
    rows, convs = rebuilt_turns(conversations, scratch, heads, family)
    prefixes, whole = _prefixes(rows, scratch)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("x", "y", "depth")]
    members = scratch.stash(convs.join(whole, "conv_id", "left").select("conv_id", *zero), "members")
    seqs = members.groupBy("x", "y", "depth").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight"))
    seqs = scratch.stash(seqs, "sequences")
    paths = prefixes.withColumnRenamed("conv_id", "seq").join(_by_block(seqs.select("seq", "weight", F.col("depth").alias("whole"))), ["seq", "block"])
    return seqs, members, scratch.stash(paths, "paths")


def _by_block(per_seq: DataFrame) -> DataFrame:
    """per_seq, with column whole, once for each block of turns: what is joined with it is spread as the turns are."""
    return per_seq.where("whole > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("whole") - 1) / BLOCK).cast("long"))))


def end_lists(members: DataFrame) -> DataFrame:
    """(x, y, depth, ends_sha256): SHA-256 of each sequence's conv_ids as text, ascending and comma-joined.

    The ids are sorted on disk where they must be and run through the hash one after the other, so a
    group of any size takes a fixed amount of memory. SHA-256 has no parallel form: a sequence's ids
    meet in one task, eight bytes each.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in ("x", "y", "depth")), strict=True))
            done, ids, at = [], b["conv_id"].to_pylist(), 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                text = ",".join(map(str, ids[at:end])).encode()
                if keys[at] == open_key:
                    state.update(b"," + text)
                else:
                    if state:
                        done.append((*open_key, state.hexdigest()))
                    open_key, state = keys[at], hashlib.sha256(text)
                at = end
            yield _rows(done)
        if state:
            yield _rows([(*open_key, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["x", "y", "depth", "ends_sha256"])

    key = ["x", "y", "depth"]
    return members.select(*key, "conv_id").repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(hashed, "x long, y long, depth long, ends_sha256 string")


def _summed_below(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, below) for every node: the sum of value over the node and the deeper nodes with its conv_id, in blocks."""
    nodes = nodes.withColumn("block", (F.col("depth") / BLOCK).cast("long"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = nodes.groupBy("conv_id", "block").agg(F.sum("value").alias("value")).select("conv_id", "block", F.coalesce(F.sum("value").over(deeper), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    own = nodes.select("conv_id", "block", "depth", F.sum("value").over(inside).alias("own"))
    return own.join(carried, ["conv_id", "block"]).select("conv_id", "depth", (F.col("own") + F.col("carried")).alias("below"))


def prefix_trie(conversations: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first `depth` rebuilt turns; conv_id is its smallest
    member, the root has depth 0. Identical conversations are collapsed into weighted sequences
    first; a sequence that some longer one begins with is dropped by an anti-join against the nodes
    that go on, and those left end in leaves; then the prefixes of one conversation of each sequence
    are added up with their weights. Every node belongs to the sequence of its smallest member,
    which holds the nodes from some depth to its end: what a subtree saves is the sum over the rest of
    the owner's nodes and over all nodes of the other sequences through it.

    Null roles and texts are empty; null turns come first, equal turn numbers go by the digest of
    role and text, repeated rows count as turns of their own. Rows with a null conv_id belong to no
    conversation. Other columns are ignored. An empty table has no root: no rows. Turns are carried
    as digests, so very long texts cost nothing behind the first step; a conversation of any length
    is spread over tasks by blocks of turns.
    """
    scratch = Scratch()
    seqs, members, paths = sequences(conversations, scratch, heads, family)
    key, up = ["depth", "x", "y"], ["px", "py"]
    root = seqs.agg(F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("depth").alias("longest")).where("conv_id is not null")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in (*key, *up, "chars")), "conv_id", "n_convs", "longest")
    grouped = paths.groupBy(*key).agg(*(F.max(c).alias(c) for c in (*up, "chars")), F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("whole").alias("longest"))
    nodes = scratch.stash(grouped.unionByName(root).withColumn("value", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    leaves = seqs.join(nodes.where("longest > depth").select(*key), key, "left_anti").select("seq", F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy(F.col("conv_id").alias("seq")).agg(F.min("depth").alias("since"), F.sum("value").alias("held"))
    facts = seqs.select("seq", F.col("depth").alias("whole")).join(leaves, "seq", "left").join(owned, "seq", "left")
    facts = scratch.stash(facts.select("seq", "whole", F.coalesce("leaf", F.lit(0)).alias("leaf"), "since", F.coalesce("held", F.lit(0)).alias("held")), "facts")
    through = paths.join(_by_block(facts).drop("whole"), ["seq", "block"])
    others = F.when(F.col("since").isNull() | (F.col("depth") < F.col("since")), F.col("held")).otherwise(0)
    counts = through.groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(others).alias("others"))
    at_root = facts.agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("since") > 0, F.col("held")).otherwise(0)).alias("others"))
    counts = counts.unionByName(at_root.where("n_leaves is not null").select(*(F.lit(0).cast("long").alias(c) for c in key), "n_leaves", "others"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(counts, key).join(children, key, "left").join(_summed_below(nodes), ["conv_id", "depth"])
    full = full.join(end_lists(members), key, "left")
    full = full.select(
        *key, *up, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("below") + F.col("others")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    full = stash(full, "trie")
    scratch.free()
    above = full.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), "n_children",
    )
    # children of a node with many of them meet it by a broadcast, where the checked number of such nodes allows it
    links, to = full.select("depth", *up, "conv_id"), ["depth", *up]
    many = small(above.where(F.col("n_children") >= MANY).drop("n_children"))
    few = above.where(F.col("n_children") < MANY).drop("n_children")
    parents = links.join(many, to).unionByName(links.join(many, to, "left_anti").join(few, to, "left")).select("conv_id", "depth", "parent_conv_id")
    out = full.join(parents, ["conv_id", "depth"])
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return out
