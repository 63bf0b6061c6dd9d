"""Spelling variants: words one edit apart, found in a trie of letter-group counts and joined to the forms that they vary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower, small, stash

#: What words are made of, and the least code points of one.
RUN, LEAST = "A-Za-zÀ-ÿ", 7
_ACCENTED = [chr(i) for i in range(0xC0, 0x100)]
#: The groups whose letters are counted, in the order of the trie's levels; the level above them is the word's length.
GROUPS = (*"enitraoshu", "dc", "lm", "gpb", "fvwyzkjqx", "".join(_ACCENTED[::2]), "".join(_ACCENTED[1::2]))
#: Bytes of the words of one subtree, which one task holds together, and queries that walk it at a time.
SUBTREE, WALKERS = 1_000_000, 200_000


def vocabulary(docs: DataFrame, least: int = LEAST, one_in: int = 31) -> DataFrame:
    """(word, n): the words of at least `least` code points that occur twice or more, by whole texts of all documents.

    One run of letters in `one_in`, told by the crc32 h of "<doc_id>:<run>", loses its code point
    h % length. Shorter runs can't become words and are skipped before they are hashed.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"([{RUN}]{{{least},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    size = F.char_length("run")
    gone = (F.col("h") % size).cast("int")
    word = F.when(F.col("h") % one_in == 0, F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, size))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def _count(group: str) -> Column:
    return (F.char_length("word") - F.char_length(F.translate("word", group, ""))).cast("int")


def _nodes(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The trie's nodes (key) of the first level on which none holds more than SUBTREE bytes of words, and that level."""
    for level in range(len(GROUPS) + 1):
        node = F.array(F.char_length("word"), *map(_count, GROUPS[:level])).alias("key")
        held = words.groupBy(node).agg(F.sum(F.char_length("word")).alias("bytes"))
        if level == len(GROUPS) or not held.where(F.col("bytes") > SUBTREE).limit(1).count():
            return scratch.stash(held.select("key"), "nodes"), level
    raise AssertionError


def _reached(level: int) -> Column:
    """The nodes on that level that a word's walk reaches: its budget is one surplus and one deficit, or one surplus to a shorter word.

    Of two words of the same length the one with the surplus on the first level where they differ
    walks to the other.
    """
    size, counts = F.char_length("word"), [F.col(f"c{g}") for g in range(level)]

    def node(longer: int, less: int | None = None, more: int | None = None) -> Column:
        own = [c - 1 if g == less else c + 1 if g == more else c for g, c in enumerate(counts)]
        found = F.array(size - longer, *own)
        return found if less is None else F.when(counts[less] > 0, found)

    same = [node(0), *(node(0, g) for g in range(level)), *(node(0, g, k) for g in range(level) for k in range(g + 1, level))]
    shorter = [node(1), *(node(1, g) for g in range(level))]
    return F.explode(F.array_compact(F.array(*same, *shorter)))


_GROUP_OF = np.zeros(256, np.int64)
for _g, _letters in enumerate(GROUPS):
    for _c in _letters:
        _GROUP_OF[ord(_c)] = _g


def _letters(words: list[str], size: int) -> np.ndarray:
    """Words of one length as rows of code points; all are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def _counted(letters: np.ndarray) -> np.ndarray:
    n, g = len(letters), len(GROUPS)
    return np.bincount((np.arange(n)[:, None] * g + _GROUP_OF[letters]).ravel(), minlength=n * g).reshape(n, g)


class Subtree:
    """A trie of words of one length: on every level a node's children by the count of that level's letters."""

    def __init__(self, letters: np.ndarray):
        self.letters, counts = letters, _counted(letters)
        self.base = int(counts.max(initial=0)) + 3
        node, self.levels = np.zeros(len(letters), np.int64), []
        for g in range(len(GROUPS)):
            known, node = np.unique(node * self.base + counts[:, g], return_inverse=True)
            self.levels.append(known)
        # a leaf's words by their first and by their second half: one edit leaves one of the halves as it is
        self.halves = []
        for half in (letters[:, : self.cut(letters)], letters[:, self.cut(letters) :]):
            key = self._key(node, half)
            order = np.argsort(key, kind="stable")
            self.halves.append((key[order], order))

    @staticmethod
    def cut(letters: np.ndarray) -> int:
        return letters.shape[1] // 2

    @staticmethod
    def _key(leaf: np.ndarray, half: np.ndarray) -> np.ndarray:
        h = leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for c in half.T:
            h = (h ^ c) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(32)
        return h

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of every word that one edit makes of a query: all queries have the words' length, or one more."""
        longer = letters.shape[1] - self.letters.shape[1]
        found = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(letters), WALKERS):
            some = letters[at : at + WALKERS]
            counts, walkers = _counted(some), np.arange(len(some))
            for q, leaf in self._walk(0, counts, walkers, np.zeros(len(some), np.int64), np.ones(len(some), bool), np.zeros(len(some), bool), longer):
                found.extend(np.stack([q + at, w]) for q, w in self._verified(some, q, leaf, longer))
        return tuple(np.concatenate(found, axis=1))

    def _walk(self, g: int, counts: np.ndarray, q: np.ndarray, node: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, longer: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first: the queries q that stand at a node go on to the children that their budgets reach.

        surplus and deficit tell whether one may still be spent; a deficit is free only behind a
        surplus among words of the same length, which finds every pair from one side.
        """
        if not len(q):
            return
        if g == len(GROUPS):
            done = ~deficit & (~surplus if longer else True)
            yield q[done], node[done]
            return
        known, own = self.levels[g], counts[q, g]
        for spent in (0, 1, -1):
            may = np.ones(len(q), bool) if not spent else (surplus & (own > 0)) if spent > 0 else deficit
            key = node * self.base + np.minimum(own - spent, self.base - 1)
            at = np.searchsorted(known, key)
            at[at == len(known)] = 0
            on = np.flatnonzero(may & (known[at] == key))
            yield from self._walk(
                g + 1, counts, q[on], at[on], surplus[on] & (spent < 1), (deficit[on] | (spent > 0 and not longer)) & (spent > -1), longer,
            )

    def _verified(self, letters: np.ndarray, q: np.ndarray, leaf: np.ndarray, longer: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cut, size = self.cut(self.letters), self.letters.shape[1]
        for second, (keys, order) in enumerate(self.halves):
            own = letters[q]
            key = self._key(leaf, own[:, cut + longer :] if second else own[:, :cut])
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            for a in range(0, len(q), 20_000):
                n = (high - low)[a : a + 20_000]
                of = np.repeat(np.arange(a, a + len(n)), n)
                word = order[np.repeat(low[a : a + len(n)], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                x, y = letters[q[of]], self.letters[word]
                if longer:
                    early, late = x[:, :size] != y, x[:, 1:] != y
                    first = np.where(early.any(1), early.argmax(1), size)
                    last = np.where(late.any(1), size - 1 - late[:, ::-1].argmax(1), -1)
                    right = last < first
                else:
                    right = (x != y).sum(1) == 1
                    # of two words with the same counts each is a query at the other's leaf: the greater one finds the pair
                    at = (x != y).argmax(1)
                    same = _GROUP_OF[x[np.arange(len(x)), at]] == _GROUP_OF[y[np.arange(len(x)), at]]
                    right &= ~same | (x[np.arange(len(x)), at] > y[np.arange(len(x)), at])
                if second:
                    right &= (x[:, :cut] != y[:, :cut]).any(1)  # else the first half has found it
                yield q[of[right]], word[right]


def _search(table: pa.Table) -> pa.Table:
    """The near pairs of one subtree's words with the queries that reach it, both ways round."""
    size, entry = table["key"][0].as_py()[0], table["entry"].to_numpy(zero_copy_only=False)
    words, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
    lengths = np.array([len(w) for w in words])
    own = np.flatnonzero(entry)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(own):
        tree = Subtree(_letters(words[own].tolist(), size))
        for longer in (0, 1):
            asked = np.flatnonzero(~entry & (lengths == size + longer))
            if len(asked):
                q, w = tree.near(_letters(words[asked].tolist(), size + longer))
                left.append(asked[q])
                right.append(own[w])
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = np.r_[a, b], np.r_[b, a]
    return pa.table({"word": pa.array(words[a], pa.string()), "near": pa.array(words[b], pa.string()), "near_n": pa.array(n[b], pa.int64())})


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n) of all pairs of words that differ by one inserted, deleted or replaced code point, both ways round.

    The trie is cut on the first level on which no subtree holds more than SUBTREE bytes, and its
    subtrees are dealt to tasks; words walk down to the cut as columns, each to the few subtrees that
    its budget reaches and that exist, and on from there in the subtree's task, depth first.
    words: (word, n), distinct, cheap to read twice.
    """
    nodes, level = _nodes(words, scratch)
    counted = words.withColumns({f"c{g}": _count(x) for g, x in enumerate(GROUPS[:level])})
    own = F.array(F.char_length("word"), *(F.col(f"c{g}") for g in range(level)))
    entries = counted.select(own.alias("key"), "word", "n", F.lit(True).alias("entry"))
    queries = counted.select(_reached(level).alias("key"), "word", "n", F.lit(False).alias("entry")).join(small(nodes), "key", "left_semi")
    return entries.unionByName(queries).groupBy("key").applyInArrow(_search, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, factor: int = 10, least: int = LEAST, one_in: int = 31) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced code point makes one of the other. A word's
    form is its most frequent near word (ties: the first in code-point order) if that is at least
    `factor` times as frequent, else null; root is where the forms lead from the word, itself without
    one. Frequencies grow by the factor along forms, so chains are short and end.

    Null texts hold no words; a null doc_id stands as an empty one in the hash; repeated rows count
    again; very long texts and words are taken whole (a subtree's task holds words of its length
    alone); other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch()
    words = scratch.stash(vocabulary(docs, least, one_in), "words")
    pairs = near_words(words, scratch)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= F.lit(factor) * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    out = stash(out, "forms")
    steps = scratch.stash(out.where("form is not null").select("word", F.col("form").alias("to")), "steps")
    while steps.join(steps.select(F.col("word").alias("to")), "to", "left_semi").limit(1).count():  # each round doubles the steps taken
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        steps = scratch.stash(steps.join(on, "to", "left").select("word", F.coalesce("beyond", "to").alias("to")), "steps")
    roots = stash(steps, "roots")
    scratch.free()
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
