"""Token counts with a two-tier length lookup: a broadcast table of frequent pre-tokens, then worker caches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table, and of a worker's cache; sketches that are merged at a time.
TABLE, CACHE, GROUPS = 20_000, 500_000, 8


def frequent_words(docs: DataFrame, most: int = TABLE) -> list[str]:
    """About the most frequent space-separated pieces of all texts, by mergeable bounded sketches.

    Each task folds its pieces into one sketch of fixed size and only sketches move, so no piece is
    shuffled; the sketches meet in a tree of three levels, GROUPS**2 and GROUPS of them at a time,
    so that no task merges those of all tasks. What the sketch gets wrong costs speed alone: every
    length is worked out exactly.
    """
    pieces = docs.select(F.spark_partition_id().alias("part"), F.explode(F.split(F.coalesce("text", F.lit("")), "[ \n]")).alias("w")).where("w <> ''")
    level = pieces.groupBy((F.col("part") % GROUPS**2).alias("part")).agg(F.expr(f"approx_top_k_accumulate(w, {2 * most})").alias("s"))
    level = level.groupBy((F.col("part") % GROUPS).alias("part")).agg(F.expr(f"approx_top_k_combine(s, {2 * most})").alias("s"))
    level = level.groupBy(F.lit(0).alias("part")).agg(F.expr(f"approx_top_k_combine(s, {2 * most})").alias("s"))  # no row without words
    got = level.select(F.expr(f"approx_top_k_estimate(s, {most})").alias("top")).first()
    return [x["item"] for x in got["top"] or []] if got else []


class _Lengths(dict):
    """Token counts of pre-tokens: the broadcast table, filled up by the worker as it goes."""

    def __init__(self, table: dict, count):
        super().__init__(table)
        self.table, self.count = table, count

    def __missing__(self, piece: str) -> int:
        if len(self) >= len(self.table) + CACHE:
            self.clear()
            self.update(self.table)
        self[piece] = n = self.count(piece)
        return n


def _encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _open_inside(sp) -> bool:
    """Whether a piece of the vocabulary holds a space mark after another character, so that words aren't independent."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, table: int = TABLE) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is what sentencepiece gives for the whole text with the model at `path`. No piece of
    the vocabulary goes on past a space or holds a line break, so a text's tokens are those of its
    space-led words and of its line breaks, and a word's count can be looked up: first in a
    broadcast table of frequent words' counts, then in the worker's cache; what neither has is
    encoded. A run of spaces belongs to the word after it, and the vocabulary's mark for a space is a
    space. A model whose pieces do span words is run over whole texts instead. Null text counts as empty: 0 tokens. Long texts cost memory in proportion; repeated
    rows, null ids and extra columns pass through or are ignored. An empty table gives no rows.
    """
    sp = _encoder(path)
    whole = _open_inside(sp)
    words = [] if whole else frequent_words(docs, table)
    counted = dict(zip(words, map(len, sp.encode(words)), strict=True)) if words else {}
    sent = docs.sparkSession.sparkContext.broadcast((whole, counted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        whole, table = sent.value
        # a word that follows a line break has no space mark: "\n" + word costs the mark and the break besides
        lengths = _Lengths(table, lambda w: len(own.encode(w)) - 2 * w.startswith("\n"))
        look = lengths.__getitem__

        def led(line: str) -> int:
            """Tokens of a line's words; all but the first follow a space."""
            first, *rest = line.split(" ")
            n = look("\n" + first) if first else 0
            if "" not in rest:
                return n + sum(map(look, rest))
            for spaces, word in re.findall("( +)([^ ]*)", line):
                n += look(" " * (len(spaces) - 1) + word) if word or len(spaces) > 1 else 1
            return n

        def tokens(text: str | None) -> int:
            if whole or not text:
                return len(own.encode(text)) if text else 0
            first, *lines = text.replace("▁", " ").split("\n")
            return led(" " + first) + len(lines) + sum(map(led, lines))

        for b in batches:
            n = pa.array([tokens(t.as_py()) for t in b["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
