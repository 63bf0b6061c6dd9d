"""Repeated passages across documents by MinHash banding of paragraphs, verified by exact Jaccard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, linked, shared_keys
from .shared import BROADCAST_ROWS, cut, discard, filled, small, stash, text_parts
from .shingles import Hashes, mixed, shingles
from .verify import verified_pairs

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A paragraph ends at a line break or with a word that ends a sentence; neighbours of fewer than MIN_WORDS words make up one paragraph.
MIN_WORDS, SHINGLE, BANDS, ROWS = 10, 5, 5, 2
#: A paragraph of more words is also cut by content: at word triples whose hash is least among REACH neighbours on either side.
LONG, REACH = 30, 5
#: Paragraphs of at most so many distinct shingles are banded by their smallest MinHash values, without loss.
SHORT = 24
#: Longs of the wider sketch, by which pairs across components are told apart.
WIDE = 4
#: Words that a run of repeated paragraphs has at least to be a passage.
RUN = 30
#: A fixed odd number and its inverse modulo 2**64, for hashes of word sequences.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


class _Ends(Hashes):
    """Hashes of words whose lowest bit says whether the word ends a sentence."""

    def __missing__(self, word: bytes) -> int:
        x = super().__missing__(word)
        self[word] = x = x & ~1 | (word[-1] in b".!?")
        return x


class Units(NamedTuple):
    """Units of several texts: the text and the place [low, high) in all their words of each, and all words' hashes."""

    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # each text's first word
    hashes: np.ndarray


def _cut_pieces(h: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the paragraphs [low, high) that have more than LONG words, cut where the words themselves say so whatever stands around them; loops of few words have no cuts."""
    x = shingles(h, 3)
    if len(x) <= 2 * REACH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    beside = np.full(len(x) - 2 * REACH, 2**64 - 1, np.uint64)
    for j in range(2 * REACH + 1):
        if j != REACH:
            np.minimum(beside, x[j : j + len(beside)], out=beside)
    at = np.flatnonzero(x[REACH:-REACH] < beside) + REACH
    inside = np.searchsorted(low, at, "right") - 1
    fits = (high[inside] - low[inside] > LONG) & (at >= low[inside] + REACH) & (at <= high[inside] - 3 - REACH)
    at, inside = at[fits], inside[fits]
    own = np.unique(inside)
    x, g = np.r_[low[own], at], np.r_[own, inside]
    order = np.argsort(x, kind="stable")
    x, g = x[order], g[order]
    same = np.r_[g[1:] == g[:-1], False]
    y = np.where(same, np.r_[x[1:], 0], high[g])
    keep = 4 * (y - x) <= 3 * (high[g] - low[g])  # else the whole is near enough
    x, y, end = x[keep], y[keep], high[g][keep]
    return np.minimum(x, end - least), np.minimum(np.maximum(y, x + least), end)


def units_of(texts: list[str | None], cache: _Ends, least: int) -> Units:
    """The units of the texts, in order of place.

    A unit is a paragraph with at least `least` words, where short ones in a row count as one. What
    is still shorter gives two units of `least` words, one that begins with it and one that ends
    with it. A paragraph of more than LONG words gives also the pieces between its cuts. So every
    word of a text of `least` words or more is in a unit.
    """
    words, ends, first = [], [], [0]
    for text in texts:
        for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
            w = line.split()
            if w:
                words += w
                ends.append(len(words))
        first.append(len(words))
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    first = np.array(first)
    if not len(h):
        return Units(*(np.zeros(0, np.int64) for _ in range(3)), first, h)
    last = (h & np.uint64(1)).astype(bool)
    last[np.array(ends) - 1] = True
    end = np.flatnonzero(last) + 1
    start = np.r_[0, end[:-1]]
    row = np.searchsorted(first, start, "right") - 1
    short = end - start < least
    new = np.r_[True, ~short[1:] | ~short[:-1] | (row[1:] != row[:-1])]
    at = np.flatnonzero(new)
    low, high, row = start[at], end[np.r_[at[1:], len(new)] - 1], row[at]
    enough = high - low >= least
    few = ~enough & (first[row + 1] - first[row] >= least)
    lo, hi, begin, stop = low[few], high[few], first[row[few]], first[row[few] + 1]
    pieces = _cut_pieces(h, low, high, least)
    lows = [low[enough], np.minimum(lo, stop - least), np.maximum(hi - least, begin), pieces[0]]
    highs = [high[enough], np.minimum(lo + least, stop), np.maximum(hi, begin + least), pieces[1]]
    key = np.unique(np.concatenate(lows) << 32 | np.concatenate(highs))
    low, high = key >> 32, key & (2**32 - 1)
    return Units(np.searchsorted(first, low, "right") - 1, low, high, first, h)


def _places(text: str, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) in characters of the words [low, high) of a text."""
    spans = np.array([m.span() for m in _WORD.finditer(text)])
    start = spans[low, 0]
    return start, spans[high - 1, 1] - start


def paragraphs(text: str | None, least: int = MIN_WORDS) -> list[tuple[int, int, list[bytes]]]:
    """(start, length, words) of a text's units in order of place, in characters of the text; see units_of()."""
    u = units_of([text], _Ends(), least)
    if not len(u.low):
        return []
    w = text.encode("utf-8", "surrogatepass").lower().split()
    start, length = _places(text, u.low, u.high)
    return [(int(s), int(n), w[lo:hi]) for s, n, lo, hi in zip(start, length, u.low, u.high, strict=True)]


def _nodes(u: Units) -> np.ndarray:
    """A hash of each unit's words."""
    n = len(u.hashes)
    power = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum(u.hashes * power(_BASE)[:n], dtype=np.uint64)]
    return mixed((total[u.high] - total[u.low]) * power(_INVERSE)[u.low] ^ (u.high - u.low).astype(np.uint64)).view(np.int64)


def _reduced(f: np.ufunc, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """f over x[low:high] of each pair."""
    return f.reduceat(np.r_[x, x[:1]], np.stack([low, high], axis=1).ravel())[::2]


def _wide_sketches(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Odd sketches of 64 * WIDE bits of the distinct shingles x[low:high] of each unit, as rows of longs; see _band_keys()."""
    out = np.zeros((len(low), WIDE), np.uint64)
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        v = np.unique(x[a:b])
        np.bitwise_xor.at(out[i], (v >> np.uint64(46)).astype(np.int64) % WIDE, np.uint64(1) << ((v >> np.uint64(40)) & np.uint64(63)))
    return out.view(np.int64)


def _band_keys(x: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size, sketch, counts, keys): how many distinct shingles x[low:high] each unit has, their odd sketch of 32 bits, how many band keys it has, and the keys.

    An odd sketch has a bit for each cell that an odd number of shingles falls into: two sketches
    differ in at most as many bits as there are shingles in one set only.

    Two sets of which the larger has n <= SHORT shingles and that are alike enough share one of their
    n - ceil(n * percent / 100) + 1 smallest values, whatever the hash: for them these are the band
    keys, each of one row. Larger sets have BANDS keys of ROWS values each. Sets that may link with
    some of either kind have both.
    """
    size = high - low
    kept = np.full((len(low), SHORT), 2**64 - 1, np.uint64)
    place = np.arange(SHORT)
    brief = np.flatnonzero(size <= SHORT)
    got = x[np.minimum(low[brief, None] + place, len(x) - 1)]
    got[place >= size[brief, None]] = 2**64 - 1
    got.sort(axis=1)
    got[:, 1:][got[:, 1:] == got[:, :-1]] = 2**64 - 1
    got.sort(axis=1)
    kept[brief] = got
    size[brief] = (got != 2**64 - 1).sum(axis=1)
    sketch = np.zeros(len(low), np.uint32)
    bit = lambda v: np.uint32(1) << (v & np.uint64(31)).astype(np.uint32)
    sketch[brief] = np.bitwise_xor.reduce(np.where(got != 2**64 - 1, bit(got), np.uint32(0)), axis=1)
    for i in np.flatnonzero(high - low > SHORT):
        distinct = np.unique(x[low[i] : high[i]])
        size[i], sketch[i] = len(distinct), np.bitwise_xor.reduce(bit(distinct))
        if len(distinct) <= SHORT:
            kept[i, : len(distinct)] = distinct
    few = np.where(size <= SHORT, size - -(-size * percent // 100) + 1, 0)
    many = np.where(100 * size >= percent * (SHORT + 1), BANDS, 0)
    width = int(few.max(initial=0))
    keys = np.zeros((len(low), width + BANDS), np.uint64)
    keys[:, :width] = kept[:, :width]
    with_bands = np.flatnonzero(many)
    if len(with_bands):
        lo, hi = low[with_bands], high[with_bands]
        seeds = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for band in range(BANDS):
            key = np.full(len(lo), band + 1, np.uint64)
            for seed in seeds[band * ROWS : (band + 1) * ROWS]:
                key = mixed(key * np.uint64(31) + _reduced(np.minimum, (x ^ seed) * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(32)), lo, hi))
            keys[with_bands, width + band] = key
    column = np.arange(width + BANDS)
    return size, sketch.view(np.int32), few + many, keys[(column < few[:, None]) | (column >= width) & (many > 0)[:, None]].view(np.int64)


def paragraph_table(docs: DataFrame, percent: int, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, number, first_word, n_words, start, length, node, size, sketch, keys) of all units.

    digest is a hash of the whole text, start and length count characters, node is a hash of the
    words, size the number of distinct shingles, sketch their odd sketch, keys the MinHash
    band keys.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Ends()
        for b in batches:
            for part, texts in text_parts(b):
                u = units_of(texts, cache, least)
                if not len(u.low):
                    continue
                own = np.r_[0, np.flatnonzero(np.diff(u.row)) + 1, len(u.row)]  # where a text's units begin
                begin = u.first[u.row]
                low, high, number = u.low - begin, u.high - begin, np.arange(len(u.row)) - np.repeat(own[:-1], np.diff(own))
                places = [_places(texts[u.row[i]], low[i:j], high[i:j]) for i, j in zip(own, own[1:], strict=False)]
                start, length = (np.concatenate([p[k] for p in places]) for k in (0, 1))
                digest = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
                x, last = shingles(u.hashes, SHINGLE), u.high - SHINGLE + 1
                size, sketch, counts, keys = _band_keys(x, u.low, last, percent)
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), keys)
                ints = [pa.array(c.astype(np.int32)) for c in (number, low, high - low, start, length)]
                columns = [part["doc_id"].take(pa.array(u.row)), pa.array(digest[u.row]), *ints, pa.array(_nodes(u)), pa.array(size.astype(np.int32)), pa.array(sketch), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "number", "first_word", "n_words", "start", "length", "node", "size", "sketch", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, digest long, number int, first_word int, n_words int, start int, length int, node long, size int, sketch int, keys array<long>")


def wide_sketches(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(node, wide) of those units of docs(text, wanted) that are wanted there: odd sketches of 64 * WIDE bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Ends()
        for b in batches:
            for part, texts in text_parts(b):
                u = units_of(texts, cache, least)
                nodes = _nodes(u) if len(u.low) else np.zeros(0, np.int64)
                own = np.flatnonzero(np.isin(nodes, part["wanted"].flatten().to_numpy(zero_copy_only=False)))
                wide = _wide_sketches(shingles(u.hashes, SHINGLE), u.low[own], u.high[own] - SHINGLE + 1) if len(own) else np.zeros((0, WIDE), np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, wide.size + 1, WIDE, dtype=np.int32), wide.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), lists], names=["node", "wide"])

    return docs.select("text", "wanted").mapInArrow(work, "node long, wide array<long>")


def _in_runs(found: DataFrame, run: int, gap: int) -> DataFrame:
    """found without units outside runs of at least so many words; a run's units overlap or are at most `gap` words apart."""
    key = ["known", "at", "digest"]
    rows = found.withColumn("known", F.col("doc_id").isNotNull()).withColumn("at", filled("doc_id"))
    span = rows.select(*key, "first_word", "n_words").distinct()
    text = Window.partitionBy(key).orderBy("first_word", "n_words")
    before = F.max(F.col("first_word") + F.col("n_words")).over(text.rowsBetween(Window.unboundedPreceding, -1))
    span = span.withColumn("before", F.coalesce(before, F.lit(0)))
    span = span.withColumn("run", F.sum((F.col("first_word") > F.col("before") + gap).cast("int")).over(text))
    fresh = F.greatest(F.lit(0), F.col("first_word") + F.col("n_words") - F.greatest("first_word", "before"))
    span = span.withColumn("words", F.sum(fresh).over(Window.partitionBy(*key, "run"))).where(F.col("words") >= run)
    return rows.join(span.select(*key, "first_word", "n_words"), [*key, "first_word", "n_words"]).select(found.columns)


def repeated_passages(docs: DataFrame, percent: int = 80, least: int = MIN_WORDS, run: int = 0) -> DataFrame:
    """One row per unit that repeats: doc_id, number, start, length, n_words, component_id, copies, keep_doc_id, removed.

    Texts are cut into units as units_of() says, which may overlap: whole paragraphs, short ones
    joined with their neighbours, and pieces of long ones, so that a passage is found wherever it
    begins. Of a run of shared words only what lies in units that are wholly within it is sure to be
    found: the parts of a paragraph of LONG words or fewer at its ends may be left. Units with the
    same words (A-Z lowered) are one node; nodes that share a MinHash band key are verified by the
    exact Jaccard of their distinct five-word shingles (100 * intersection >= percent * union) and
    linked. Among sets of SHORT shingles or fewer no pair is missed; BANDS x ROWS finds a pair of
    larger ones at the threshold with a chance over 0.994, and surer above it. A component keeps its
    first unit (smallest doc_id, then place), with what overlaps it there, and the rest is marked
    removed. Units of one text that only overlap are no repeat. With `run`, repeated units count only
    in runs of at least so many words (gaps of fewer than `least` words are bridged): shorter repeats,
    such as a site's header line, are then no passages. Only components with two units or more are
    returned, so a document without repeats has no row.

    `least` is at least five. start and length count characters. Null, empty and shorter texts have
    no units; a null doc_id counts as the largest; rows that repeat count as repeats; columns other
    than doc_id and text are not read; long texts cost memory in proportion; an empty table gives an
    empty result.
    """
    table = stash(paragraph_table(docs, percent, least), "paragraphs")
    keys = table.select("node", "size", F.lit(0).alias("pos"), "sketch", F.explode("keys").alias("key"))
    shared = shared_keys(keys, alone=True)

    def unit_sets():
        cache = _Ends()

        def find(text: str, wanted: dict[int, int]) -> dict[int, np.ndarray]:
            words, out = text.encode("utf-8", "surrogatepass").lower().split(), {}
            for node, place in wanted.items():
                own = words[place >> 32 : (place >> 32) + (place & 0xFFFFFFFF)]
                h = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
                if len(h) and _nodes(Units(None, np.array([0]), np.array([len(h)]), None, h))[0] == node:
                    out[node] = np.unique(shingles(h, SHINGLE))
            return out

        return find

    def verified(pairs: DataFrame) -> DataFrame:
        nodes = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        place = F.shiftleft(F.col("first_word").cast("long"), 32).bitwiseOR(F.col("n_words").cast("long")).alias("place")
        holder = table.select("node", F.struct(F.col("doc_id").isNull().alias("unknown"), filled("doc_id"), place).alias("m")).join(small(nodes), "node", "left_semi")
        holder = cut(holder.groupBy("node").agg(F.min("m").alias("m")).select("node", "m.doc_id", "m.place"))
        a, b = (small(holder).select(F.col("node").alias(s), F.col("doc_id").alias(f"doc_{s}"), F.col("place").alias(f"place_{s}")) for s in "ab")
        return verified_pairs(cut(pairs.join(a, "a").join(b, "b")), docs, unit_sets, percent)

    def fits(x, y):
        """Sketches differ in at most as many bits as there are shingles in one set only, of which linking sets have few."""
        xs, ys = x.getField("size"), y.getField("size")
        wide = sum(F.bit_count(x.getField("wide")[k].bitwiseXOR(y.getField("wide")[k])) for k in range(WIDE))
        apart = F.greatest(F.bit_count(x.getField("sketch").bitwiseXOR(y.getField("sketch"))), F.coalesce(wide, F.lit(0)))
        return (xs * 100 >= ys * percent) & (ys * 100 >= xs * percent) & (apart * (100 + percent) <= (xs + ys) * (100 - percent))

    def wide(nodes: DataFrame) -> DataFrame:
        """Read again from one document that holds each node; a node that isn't found there stays without."""
        holder = table.join(small(nodes), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        wanted = holder.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("node").alias("wanted"))
        again = docs.select("doc_id", "text").where("text is not null").join(small(cut(wanted), BROADCAST_ROWS // 8), "doc_id")
        return wide_sketches(again, least).groupBy("node").agg(F.first("wide").alias("wide"))

    label = stash(components(linked(shared, verified, fits, wide)).withColumnRenamed("id", "node"), "labels")
    again = shared.where("n > 1").select("me.node").distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("component"))
    named = stash(label.unionByName(again), "named")
    discard(shared)
    at = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d")
    found = stash(table.drop("size", "sketch", "keys").join(small(named), "node"), "found")
    discard(table, named, label)
    if run:
        every, found = found, stash(_in_runs(found, run, least - 1), "runs")
        discard(every)
    once = found.groupBy("component", at, "start", "length").agg(F.count(F.lit(1)).alias("n"))
    end = F.col("start") + F.col("length")
    group = once.groupBy("component").agg(F.sum("n").alias("copies"), F.min(F.struct("d", "start", "length")).alias("first"), F.max("d").alias("last"), F.min(end).alias("end"), F.max("start").alias("start"), (F.max("n") > 1).alias("again"))
    apart = (F.col("first.d") < F.col("last")) | (F.col("start") >= F.col("end")) | F.col("again")  # else units of one text that only overlap
    group = stash(group.where((F.col("copies") > 1) & apart).select("component", "copies", "first"), "groups")
    out = found.join(small(group), "component")
    kept = (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("first.d")) & (F.col("start") < F.col("first.start") + F.col("first.length")) & (end > F.col("first.start"))
    return out.select("doc_id", "number", "start", "length", "n_words", F.col("component").alias("component_id"), "copies", F.when(F.col("first.d") < 2**63 - 1, F.col("first.d")).alias("keep_doc_id"), (~kept).alias("removed"))
