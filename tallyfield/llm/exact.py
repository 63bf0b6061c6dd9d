"""Exact dedup by a tree merge of sorted digest runs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh, small, stash


def representatives(df: DataFrame, key: list[str], order: str, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """(run, key..., best, n): for every key of every run, the smallest `order` of all rows with that key and how many there are.

    df has a column run in [0, runs). Level by level the runs of fan_in neighbours are dealt to
    the same (group, key) and merged in key order, keeping the smallest order value; a hot key is
    never more than fan_in rows of a level in one task. The root's rows then go back to the
    leaves' keys, of which each key has at most `runs`.
    """
    leaf = stash(df.groupBy("run", *key).agg(F.min(F.struct(order)).alias("best"), F.count(F.lit(1)).alias("n")), "runs")
    level, width = leaf, runs
    while width > 1:
        width = -(-width // fan_in)
        # the minimum of a struct is no fixed-width state: Spark merges sorted runs here, not hash tables
        level = level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *key).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    top = level.where("n > 1").select(*key, F.col("best").getField(order).alias("top"), F.col("n").alias("all"))
    out = leaf.join(top, key, "left")
    return out.select("run", *key, F.coalesce("top", F.col("best").getField(order)).alias("best"), F.coalesce("all", "n").alias("n"))


def exact_dedup(docs: DataFrame, text: Column | None = None, runs: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z (null is empty); of equal texts the row
    with the largest doc_id stays. Rows are dealt to runs by a hash of doc_id, each run is reduced
    to its distinct digests, and the runs are merged in rounds. Equality is verified by carrying,
    beside SHA-256, the byte length and an independent 64-bit hash in the key: texts that differ in
    either are never merged. A null doc_id takes part but never stays beside another; of rows that
    repeat a doc_id all of the largest are kept. An empty table gives an empty result.
    """
    rows = _decided(docs, F.col("text") if text is None else text, runs)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes")


def _key(text: Column) -> list[Column]:
    """What equal texts share: digest, check, n_bytes."""
    norm = ascii_lower(text)
    return [F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(norm).alias("check"), F.octet_length(norm).cast("long").alias("n_bytes")]


def _decided(docs: DataFrame, text: Column, runs: int = 64) -> DataFrame:
    rows = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"), *_key(text))
    rows = stash(rows, "digests")
    key = ["digest", "check", "n_bytes"]
    back = F.struct(F.col("doc_id").isNull().alias("unknown"), F.bitwise_not("doc_id").alias("id"))  # known ids first, the largest first of all
    best = representatives(rows.withColumn("back", back), key, "back", runs)
    out = rows.join(best, ["run", *key])
    keep = F.bitwise_not("best.id")
    return out.select(
        "doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), *key,
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() drops, told by doc_id and text, with all their columns.

    Of rows that repeat a kept doc_id with its text all stay. Null texts equal empty ones; a null
    doc_id never stays beside another; long texts are hashed whole; an empty table stays empty.
    """
    key = ["doc_id", "digest", "check", "n_bytes"]
    dropped = small(stash(_decided(docs, F.col("text")).where("not kept").select(key).distinct(), "dropped")).alias("x")
    own = ["doc_id", *(fresh(c, docs.columns) for c in key[1:])]
    rows = docs.withColumns(dict(zip(own[1:], _key(F.col("text")), strict=True))).alias("d")
    same = [F.col(f"d.{o}").eqNullSafe(F.col(f"x.{c}")) if c == "doc_id" else F.col(f"d.{o}") == F.col(f"x.{c}") for o, c in zip(own, key, strict=True)]
    return rows.join(dropped, same, "left_anti").select(docs.columns)
