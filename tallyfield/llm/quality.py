"""A byte-level convolutional network in numpy that scores whole texts for quality."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stash

#: Fixed shape of the network: bytes a chunk and bytes that neighbours share, embedding, filters and their width.
CHUNK, SHARED, EMBED, FILTERS, WIDTH = 512, 64, 4, 24, 6
PAD = 256
#: Bytes of text that a network is fitted on at most.
LEARNED_BYTES = 256_000_000


def chunks_of(text: str | None) -> np.ndarray:
    """Overlapping chunks (n, CHUNK) that cover the whole text's UTF-8 bytes; the rest of the last is padding. Null is empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = CHUNK - SHARED
    n = max(1, -(-(len(raw) - SHARED) // step))
    flat = np.full((n - 1) * step + CHUNK, PAD, dtype=np.int16)
    flat[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


class ByteNet:
    """embedding -> filters over every place of a chunk -> max over places -> max and mean over chunks -> one probability."""

    def __init__(self, seed: int = 7, params: dict[str, np.ndarray] | None = None):
        if params is not None:
            self.p = params
            return
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (257, EMBED)).astype(np.float32), "k": r.normal(0, 0.25, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32), "v": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32),
        }
        self.p["emb"][PAD] = 0

    def places(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["emb"][ids].reshape(len(ids), -1)
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, ::EMBED]

    def pooled(self, ids: np.ndarray, where: bool = False):
        """Per chunk and filter the largest response, and its place if asked for; a few chunks at a time."""
        top, at = [], []
        for i in range(0, len(ids), 32):
            part = np.ascontiguousarray(self.places(ids[i : i + 32]))
            z = (self.p["k"].T @ part.reshape(-1, WIDTH * EMBED).T).reshape(FILTERS, len(part), -1)  # places last: the maximum runs over neighbours
            if where:
                at.append(z.argmax(axis=2).T)
            top.append(z.max(axis=2).T)
        top = np.concatenate(top) + self.p["b"]
        return (top, np.concatenate(at)) if where else top

    def score(self, texts: list[str | None]) -> np.ndarray:
        parts = [chunks_of(t) for t in texts]
        if not parts:
            return np.zeros(0)
        h = np.maximum(self.pooled(np.concatenate(parts)), 0)
        first = np.r_[0, np.cumsum([len(x) for x in parts])[:-1]]
        n = np.array([[len(x)] for x in parts], np.float32)
        doc = np.hstack([np.maximum.reduceat(h, first, axis=0), np.add.reduceat(h, first, axis=0) / n])
        return 1 / (1 + np.exp(-np.clip((doc @ self.p["v"] + self.p["c"]).astype(np.float64), -30, 30)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """score() of a column, some texts at a time."""
        return np.concatenate([np.zeros(0), *(self.score(texts[i : i + 64].to_pylist()) for i in range(0, len(texts), 64))])

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 700, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam on the log loss, both labels drawn equally often."""
        r = np.random.default_rng(seed)
        parts = [chunks_of(t) for t in texts]
        sides = [np.flatnonzero(labels == y) for y in (0, 1)]
        m, s = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(x, batch // 2) for x in sides if len(x)])
            g = self._gradient([parts[i] for i in pick], labels[pick].astype(np.float32))
            now = rate * (1 - step / (steps + 1)) + rate * 0.02
            for k, x in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                x -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
            self.p["emb"][PAD] = 0
        return self

    def _gradient(self, parts: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p, ids = self.p, np.concatenate(parts)
        z, at = self.pooled(ids, where=True)
        h = np.maximum(z, 0)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        first = np.r_[0, np.cumsum([len(x) for x in parts])[:-1]]
        n = np.array([len(x) for x in parts], np.float32)
        top = np.maximum.reduceat(h, first, axis=0)
        doc = np.hstack([top, np.add.reduceat(h, first, axis=0) / n[:, None]])
        d = (1 / (1 + np.exp(-np.clip(doc @ p["v"] + p["c"], -30, 30))) - y) / len(y)
        mine = h == top[owner]
        dz = d[owner, None] * (p["v"][FILTERS:] / n[owner, None] + p["v"][:FILTERS] * mine / np.maximum(np.add.reduceat(mine, first, axis=0, dtype=np.float32), 1)[owner])
        dz = (dz * (z > 0)).astype(np.float32)
        near = at[:, :, None] + np.arange(WIDTH)  # chunk, filter, place
        bytes_ = ids[np.arange(len(ids))[:, None, None], near]
        seen = p["emb"][bytes_].reshape(len(ids), FILTERS, -1)
        back = dz[:, :, None, None] * p["k"].T.reshape(FILTERS, WIDTH, EMBED)
        emb = np.stack([np.bincount(bytes_.ravel(), back[..., e].ravel(), 257) for e in range(EMBED)], axis=1)
        return {"emb": emb.astype(np.float32), "k": np.einsum("cf,cfw->wf", dz, seen, optimize=True), "b": dz.sum(0), "v": (d @ doc).astype(np.float32), "c": np.array([d.sum()], np.float32)}


def held_out(doc_id=None):
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5. Null ids are held out."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def trained(docs: DataFrame, labels: DataFrame, sample: int = 2000, seed: int = 7) -> ByteNet:
    """A network fitted on at most `sample` labelled texts of each label, the same for any partitioning.

    Only labels whose document isn't held out take part; the choice goes by a hash of doc_id, and of
    rows that repeat a doc_id the first text counts. This is the operator's one bounded sample;
    scoring covers every text. A sample of more than LEARNED_BYTES is an error: ask for a smaller one.
    The fit runs in a task, and only the network's parameters come to the driver.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(sample).unionByName(known.where("quality = 1").orderBy(*order).limit(sample))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = stash(rows, "learned")
    if (size := rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > LEARNED_BYTES:
        raise ValueError(f"{size} bytes of text to learn from; take a smaller sample")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(learned).to_pandas().sort_values(["doc_id", "text"], kind="stable") if learned else None
        if rows is not None and rows["quality"].nunique() == 2:
            net = ByteNet(seed).fit(rows["text"].tolist(), rows["quality"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)])], names=["net"])

    got = rows.select("doc_id", "quality", "text").coalesce(1).mapInArrow(fitted, "net binary").collect()
    discard(rows)
    return ByteNet(seed, pickle.loads(got[0]["net"]) if got else None)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 2000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    score is the network's probability of label 1, from the text's bytes alone; predicted is 1 from
    `threshold` on. Null and empty texts get the score of an all-padding chunk. Without two labels
    to learn from the network stays as it began. Long texts are scored whole, some chunks at a time.
    Equal texts get equal scores, so repeated rows and ties come back alike; of repeated labels the
    largest counts; columns other than doc_id and text are not read; an empty table gives no rows.
    """
    net = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample).p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet(params=net.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(own.scores(b["text"]))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that the classifier rejects, with all their columns.

    Null and empty texts are judged like any other by the score of an all-padding chunk; long texts
    are scored whole; repeated rows get the same verdict; an empty table stays empty.
    """
    net = docs.sparkSession.sparkContext.broadcast(trained(docs, labels).p)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet(params=net.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):  # no second copy of the whole batch
                part = b.slice(i, 500)
                yield part.filter(pa.array(own.scores(part["text"]) >= threshold))

    return docs.mapInArrow(good, docs.schema)
