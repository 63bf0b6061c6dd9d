"""Language of documents and of their words, by a linear-chain conditional random field."""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, small, stash, text_parts

#: Buckets of hashed features, words of a block of the forward-backward pass, code points whose features are held at a time.
BUCKETS, BLOCK, PIECE = 1 << 16, 64, 1 << 19
#: Rows of each language that the field learns from, of all languages together, and the longest text among them.
SAMPLE, ALL_SAMPLES, LONGEST = 240, 24_000, 20_000

_BEGIN, _END = 1, 2  # stand before and behind a word, below any letter


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 2 for a letter, 1 for a mark that goes on with a word, else 0; and its one-to-one lower case."""
    kind, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            kind[i] = 2
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
        elif i >= 0x300 and unicodedata.category(c)[0] == "M":
            kind[i] = 1
    return kind, lower


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: a letter and the letters and marks behind it."""
    kind = _tables()[0][codes]
    inside = kind == 2
    if (kind == 1).any():  # a mark belongs to the word that it follows
        before = np.maximum.accumulate(np.where(kind != 1, np.arange(len(kind)), -1))
        inside = np.where(before >= 0, kind[before] == 2, False)
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _features(codes: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Hashed features of the words [start, end) of codes: n-grams of each place, affixes, and the words' own hashes.

    Returns (grams (2, places), first place of each word, places of each word, affixes (4, words),
    hashes of whole words). Bucket 0 stands for none.
    """
    size = end - start
    first = np.r_[0, np.cumsum(size + 2)[:-1]]
    z = np.empty(int((size + 2).sum()) + 4, np.uint64)
    z[first], z[first + size + 1], z[-4:] = _BEGIN, _END, _END
    at = np.repeat(start - first - 1, size) + (places := np.arange(size.sum()) + np.repeat(2 * np.arange(len(size)) + 1, size))
    z[places] = _tables()[1][codes[at]]
    p = np.uint64(0x9E3779B97F4A7C15)
    two = z[:-1] * p + z[1:]
    three = two[:-1] * p + z[2:]
    n = len(z) - 4
    last = first + size  # a word's last letter
    grams = np.stack([_mixed(two[:n] ^ np.uint64(2)), _mixed(three[:n] ^ np.uint64(3))]) % np.uint64(BUCKETS - 1) + np.uint64(1)
    grams[:, last + 1] = 0  # the places at which the next word would be read
    grams[1, last] = 0
    three_in = three[first] * p + z[np.minimum(first + 3, last + 1)]
    four_in = three_in * p + z[np.minimum(first + 4, last + 1)]
    back = [z[np.maximum(last - i, first)] for i in range(4)]
    three_out = (back[2] * p + back[1]) * p + back[0]
    four_out = back[3] * p * p * p + three_out
    affixes = np.stack([_mixed(h ^ np.uint64(k)) for k, h in zip((5, 7, 11, 13), (three_in, four_in, three_out, four_out), strict=True)]) % np.uint64(BUCKETS - 1) + np.uint64(1)
    spread = _mixed(z[:n] + np.uint64(0x51) * (np.arange(n, dtype=np.uint64) - np.repeat(first, size + 2).astype(np.uint64)))
    return grams.astype(np.int64), first, (2 * size + 1).astype(np.float32), affixes.astype(np.int64), _mixed(np.add.reduceat(spread, first))


class Field:
    """Weights of a linear-chain field over languages: emissions of hashed n-grams and affixes and of lexicon words, and transitions.

    A word's emission for a language is the mean weight of its n-grams and the weights of its
    affixes, and, for every language whose lexicon holds the word, a weight of that pair of
    languages. `params` holds plain arrays, to be sent to workers.
    """

    def __init__(self, langs: list[str], params: dict[str, np.ndarray] | None = None):
        n = len(langs)
        self.langs = langs
        self.p = params or {
            "grams": np.zeros((BUCKETS, n), np.float32), "affixes": np.zeros((BUCKETS, n), np.float32), "lexicon": np.zeros((n, n), np.float32),
            "step": np.zeros((n, n), np.float32), "begin": np.zeros(n, np.float32), "known": np.zeros(0, np.uint64), "in": np.zeros((1, n), np.float32),
        }

    def lexicon(self, hashes: np.ndarray) -> np.ndarray:
        """Which lexicons (columns) hold each word: rows of the table `in`, whose last row is empty."""
        known = self.p["known"]
        if not len(known):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        return np.where(known[at] == hashes, at, len(known))

    def emissions(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, at = [np.zeros((0, len(self.langs)), np.float32)], 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE)))
            grams, first, n, affixes, hashes = _features(codes, start[at:to], end[at:to])
            w = self.p["grams"]
            e = np.add.reduceat(w[grams[0]] + w[grams[1]], first, axis=0) / n[:, None]
            e += self.p["affixes"][affixes].sum(0) + (self.p["in"] @ self.p["lexicon"])[self.lexicon(hashes)]
            out.append(e)
            at = to
        return np.concatenate(out)

    def marginals(self, emissions: np.ndarray, opens: np.ndarray, pairs: bool = False):
        """Posterior of every word's language, by forward-backward over all sequences at once; opens tells the first word of each.

        Words stand in blocks. The blocks' products of transition matrices are taken side by side, a
        vector runs over the blocks, then all blocks are gone through side by side. A sequence's
        first word forgets what stands before it. With pairs also the sum of the posteriors of
        (word before, word), over neighbours in a sequence.
        """
        n, k = emissions.shape
        m = max(1, -(-n // BLOCK))
        e = np.ones((m * BLOCK, k))
        e[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-30
        new = np.ones(m * BLOCK, bool)
        new[:n] = opens
        e, new = e.reshape(m, BLOCK, k), new.reshape(m, BLOCK)
        step, begin = (np.exp(self.p[x].astype(np.float64) - self.p[x].max()) for x in ("step", "begin"))

        def on(state, t, i=slice(None)):
            """state: rows over languages, of the blocks i, moved on to word t."""
            wide = new[i, t].reshape(-1, *[1] * (state.ndim - 1))
            moved = np.where(wide, state.sum(-1, keepdims=True) * begin, state @ step)
            moved *= e[i, t].reshape(-1, *[1] * (state.ndim - 2), k)
            return moved

        product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
        for t in range(BLOCK):
            product = on(product, t)
            product /= product.sum(axis=(1, 2), keepdims=True)
        ahead, behind = np.empty((m, k)), np.empty((m, k))
        v = np.full(k, 1 / k)
        for b in range(m):
            ahead[b] = v
            v = v @ product[b]
            v = v / v.sum()
        v = np.full(k, 1 / k)
        for b in range(m - 1, -1, -1):
            behind[b] = v
            v = product[b] @ v
            v = v / v.sum()
        alpha, beta = np.empty((m, BLOCK, k)), np.empty((m, BLOCK, k))
        v = ahead
        for t in range(BLOCK):
            v = on(v, t)
            v /= v.sum(1, keepdims=True)
            alpha[:, t] = v
        v = behind
        for t in range(BLOCK - 1, -1, -1):
            beta[:, t] = v
            seen = v * e[:, t]
            v = np.where(new[:, t, None], (seen @ begin)[:, None], seen @ step.T)
            v /= v.sum(1, keepdims=True)
        alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
        post = alpha * beta
        post /= post.sum(1, keepdims=True)
        if not pairs:
            return post
        inner = np.flatnonzero(~opens)
        x = alpha[inner - 1][:, :, None] * step * (beta * e.reshape(-1, k)[:n])[inner][:, None, :]
        return post, (x / x.sum(axis=(1, 2), keepdims=True)).sum(0)

    def learn_words(self, texts: list[str], labels: list[int], least: int = 3, most: int = 20_000) -> None:
        """Fills the lexicons: up to `most` words a language that its texts hold `least` times or more, the most frequent first."""
        found: dict[int, np.ndarray] = {}
        for lang in range(len(self.langs)):
            seen = Counter()
            for text, y in zip(texts, labels, strict=True):
                codes = _codes(text)
                start, end = words_of(codes)
                if y == lang and len(start):
                    seen.update(_features(codes, start, end)[4].tolist())
            for h, _ in sorted(((h, n) for h, n in seen.items() if n >= least), key=lambda x: (-x[1], x[0]))[:most]:
                found.setdefault(h, np.zeros(len(self.langs), np.float32))[lang] = 1
        known = sorted(found)
        self.p["known"], self.p["in"] = np.array(known, np.uint64), np.stack([*(found[h] for h in known), np.zeros(len(self.langs), np.float32)])

    def fit(self, texts: list[str], labels: list[int], steps: int = 300, sequences: int = 48, length: int = 64, span: int = 12, rate: float = 0.08, seed: int = 5) -> Field:
        """Adam on the log-likelihood of spliced sequences: spans of about `span` words from texts of different languages follow one another.

        The splices stand in for code-switched texts, of which the labels hold none: they are what
        the transitions are learned from.
        """
        r, k = np.random.default_rng(seed), len(self.langs)
        known = []
        for text, y in zip(texts, labels, strict=True):
            codes = _codes(text)
            start, end = words_of(codes)
            if len(start):
                known.append((y, codes, start, end))
        by = [[i for i, x in enumerate(known) if x[0] == y] for y in range(k)]
        able = [y for y in range(k) if by[y]]
        if len(able) < 2:
            return self
        names = ("grams", "affixes", "lexicon", "step", "begin")
        m, s = ({x: np.zeros_like(self.p[x]) for x in names} for _ in range(2))
        for step in range(1, steps + 1):
            codes, start, end, gold, opens, base = [], [], [], [], [], 0
            for _ in range(sequences):
                room, y = length, int(r.choice(able))
                opens.append(sum(map(len, gold)))
                while room > 0:
                    _, c, a, b = known[int(r.choice(by[y]))]
                    i = int(r.integers(len(a)))
                    j = min(len(a), i + min(room, int(r.geometric(1 / span))))
                    part = c[a[i] : b[j - 1]]
                    codes.append(part)
                    start.append(a[i:j] - a[i] + base)
                    end.append(b[i:j] - a[i] + base)
                    base += len(part)
                    gold.append(np.full(j - i, y))
                    room -= j - i
                    y = int(r.choice(able))
            g = self._gradient(np.concatenate(codes), np.concatenate(start), np.concatenate(end), np.concatenate(gold), np.isin(np.arange(sum(map(len, gold))), opens))
            now = rate * (1 - step / (steps + 1)) + rate * 0.02
            for x in names:
                m[x] += 0.1 * (g[x] - m[x])
                s[x] += 0.001 * (g[x] ** 2 - s[x])
                self.p[x] -= now * (m[x] / (1 - 0.9**step)) / (np.sqrt(s[x] / (1 - 0.999**step)) + 1e-6)
            self.p["grams"][0] = self.p["affixes"][0] = 0
        return self

    def _gradient(self, codes, start, end, gold, opens) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the gold languages."""
        k, n = len(self.langs), len(start)
        grams, first, places, affixes, hashes = _features(codes, start, end)
        post, pairs = self.marginals(self.emissions(codes, start, end), opens, pairs=True)
        d = post.copy()
        d[np.arange(n), gold] -= 1
        d /= n
        per_place = np.repeat(d / places[:, None], np.diff(np.r_[first, grams.shape[1]]), axis=0)
        inner = np.flatnonzero(~opens)
        said = np.zeros((k, k))
        np.add.at(said, (gold[inner - 1], gold[inner]), 1)
        out = {
            "grams": np.stack([sum(np.bincount(x, per_place[:, y], BUCKETS) for x in grams) for y in range(k)], axis=1),
            "affixes": np.stack([sum(np.bincount(x, d[:, y], BUCKETS) for x in affixes) for y in range(k)], axis=1),
            "lexicon": self.p["in"][self.lexicon(hashes)].T @ d, "step": (pairs - said) / n, "begin": d[opens].sum(0),
        }
        return {x: v.astype(np.float32) for x, v in out.items()}

    def label(self, texts: list[str | None]):
        """(posteriors of all words, starts, ends, words before each text): the words of all texts, with places inside their own text."""
        lens = np.array([len(t or "") for t in texts], np.int64)
        codes = _codes("\n".join(t or "" for t in texts))
        base = np.cumsum(lens + 1) - lens - 1
        start, end = words_of(codes)
        bounds = np.searchsorted(start, np.r_[base, len(codes) + 1])
        opens = np.zeros(len(start), bool)
        opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        post = self.marginals(self.emissions(codes, start, end), opens) if len(start) else np.zeros((0, len(self.langs)))
        shift = np.repeat(base, np.diff(bounds))
        return post, start - shift, end - shift, bounds


def held_out(doc_id=None):
    """Whether a document is kept from learning: crc32 of its id as text is 1 modulo 3. Null ids are held out."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def trained(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on a bounded sample: of each language `sample` texts of at most LONGEST code points, ALL_SAMPLES in all.

    Which, goes by a hash of doc_id, the same for any partitioning; held-out documents never take
    part, repeated rows count once. Half of the texts fill the lexicons, the others teach the
    weights, so that a lexicon is weighted by how it does on texts that it has not seen. This is the
    operator's one sample; every document is labelled.
    """
    able = docs.where("lang is not null and doc_id is not null").where(~held_out()).where(F.char_length("text").between(1, LONGEST))
    able = able.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("t"))
    ids = stash(able.groupBy("lang", "doc_id", "t").agg(F.lit(1).alias("one")).withColumn("h", F.xxhash64("doc_id", "t")), "able")
    known = small(stash(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "known"))  # a row a language: texts meet it where they are
    # of a language with many texts only those with the least hashes, about 4 * sample of them, go to the task that numbers them
    least = ids.join(known, "lang").where(F.col("h").cast("double") < (8.0 * sample / F.col("n") - 1) * 2.0**63)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))
    chosen = least.withColumn("place", place).where(F.col("place") <= sample).select("lang", "doc_id", "t", "place", "h")
    chosen = chosen.orderBy("place", "lang").limit(ALL_SAMPLES)  # of many languages each gives fewer
    rows = able.join(F.broadcast(chosen), ["lang", "doc_id", "t"]).groupBy("lang", "doc_id", "t", "h").agg(F.min("text").alias("text"))
    rows, _ = rows.toArrow().to_pandas(), discard(ids)
    rows = rows.sort_values(["h", "lang", "doc_id", "t"], kind="stable")
    langs = sorted(rows["lang"].unique())
    y = rows["lang"].map({x: i for i, x in enumerate(langs)}).tolist()
    texts, field = rows["text"].tolist(), Field(langs)
    if len(langs) > 1:
        field.learn_words(texts[::2], y[::2])
        field.fit(texts[1::2], y[1::2])
    return field


def document_languages(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Every word's posterior over the learned languages comes from the field (see Field); lang_pred
    is the language that most of the document's words are expected to be in, score the expected
    share of its words. Ties go to the first language by name. A null text, or one without a
    letter, is "und" with score 0, as is every text if no language could be learned; with one
    language all others are in it. Long texts are labelled whole; repeated rows come back alike;
    columns other than doc_id, text and lang (lang for learning alone) are not read; an empty table
    gives no rows.
    """
    field = field or trained(docs)
    sent = docs.sparkSession.sparkContext.broadcast((field.langs, field.p))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for b in batches:
            for part, texts in text_parts(b):
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                if own.langs:
                    post, _, _, bounds = own.label(texts)
                    some = np.flatnonzero(np.diff(bounds))
                    if len(some):
                        share = np.add.reduceat(post, bounds[some], axis=0) / np.diff(bounds)[some, None]
                        best = share.round(12).argmax(axis=1)
                        scores[some] = np.clip(share[np.arange(len(some)), best], 0, 1)
                        for i, y in zip(some.tolist(), best.tolist(), strict=True):
                            langs[i] = own.langs[y]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def language_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of docs: doc_id and spans, the runs of neighbouring words whose likeliest language is the same.

    A span has start and end (code points of the text, end behind the last word), lang, words and
    score, the words' mean posterior. Texts without a letter have no spans; odd rows are as in
    document_languages().
    """
    field = field or trained(docs)
    sent = docs.sparkSession.sparkContext.broadcast((field.langs, field.p))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("score", pa.float64())]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for b in batches:
            for part, texts in text_parts(b):
                found: list[list] = [[] for _ in texts]
                if own.langs:
                    post, start, end, bounds = own.label(texts)
                    best, top = post.argmax(axis=1), post.max(axis=1)
                    for i in np.flatnonzero(np.diff(bounds)):
                        a, z = bounds[i], bounds[i + 1]
                        cuts = np.r_[a, a + 1 + np.flatnonzero(np.diff(best[a:z])), z]
                        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                            found[i].append({"start": int(start[x]), "end": int(end[y - 1]), "lang": own.langs[best[x]], "words": y - x, "score": float(top[x:y].mean())})
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(spans, "doc_id long, spans array<struct<start:long,end:long,lang:string,words:long,score:double>>")
