"""Best-fit packing of token pieces into sequences, with lower bounds that certify a partition or send it to an exchange."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash, text_slices

#: Words, and parts of words, whose ids a worker may keep; pieces of a partition; pieces that a partition gives to an exchange; partitions of an exchange.
CACHE_WORDS, GROUP, GIVEN, MERGED = 500_000, 20_000, 3_000, 8
#: Bytes of text whose words are looked up together, for each word of the cache: enough to find most words more than once, few enough to leave room in the cache.
AT_ONCE = 4


#: Words of printable ASCII and Latin-1 letters, which normalisation only lowers, and how the tokenizer cuts them.
_PLAIN, _SPECIAL = r"\A[!-~À-ÖØ-öø-ÿ]+\z", "<|"
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"


def _byte_letters() -> np.ndarray:
    """The public byte-level alphabet as UTF-16 units: printable bytes stand for themselves, the others for the characters from 256 on; the space stays, as it ends a part."""
    rest = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
    letters = np.arange(256, dtype="<u2")
    letters[rest] = np.arange(256, 256 + len(rest))
    letters[32] = 32
    return letters


class _Kept:
    """What learn gives for keys, kept in two halves: a full young half becomes the old one, whose keys move back as they come up again, so that rare keys push out only each other."""

    def __init__(self, learn: Callable[[list], list], most: int):
        self.learn, self.most, self.young, self.old = learn, most, {}, {}

    def _of(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if at := [i for i, v in enumerate(found) if v is None]:
            new = [keys[i] for i in at]
            values = list(map(self.old.get, new))
            if unknown := [k for k, v in zip(new, values, strict=True) if v is None]:
                learned = iter(self.learn(unknown))
                values = [next(learned) if v is None else v for v in values]
            if len(self.young) + len(new) > self.most // 2:
                self.young, self.old = {k: v for k, v in zip(keys, found, strict=True) if v is not None}, self.young
            self.young.update(zip(new, values, strict=True))
            for i, v in zip(at, values, strict=True):
                found[i] = v
        return found

    def of(self, keys: pa.Array) -> pa.Array:
        """What distinct keys have, looked up in blocks that fit a half."""
        blocks = (keys.slice(i, self.most // 2) for i in range(0, len(keys), self.most // 2))
        found = [pa.array(self._of(b.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()) for b in blocks]
        return pa.concat_arrays(found or [pa.array([], pa.large_binary())])

    def joined(self, rows: pa.ListArray) -> pa.Array:
        """What the keys of each row have, one after another; a key is looked up once, however often it comes up."""
        code = rows.flatten().dictionary_encode()
        _, ends, data = self.of(code.dictionary).take(code.indices).buffers()
        at = rows.offsets.to_numpy()
        ends = np.frombuffer(ends, np.int64)[at - at[0]] if len(code) else np.zeros(len(at), np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


class WordIds:
    """Ids of white-space separated words, as bytes; kept by the worker from task to task, up to a bound.

    Plain words take a short way to the same ids: lowered, cut by the tokenizer's pattern and handed to its
    model, all new parts at once; a part ends with the one token that says so. All others, and what may hold
    a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str, cache: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        ids = self.model.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(ids.values()) + 1, dtype=bool)
        self.last[[i for t, i in ids.items() if t.endswith(self.tokenizer.model.end_of_word_suffix or "</w>")]] = True
        self.letters = _byte_letters()
        self.words, self.parts = (_Kept(learn, cache or CACHE_WORDS) for learn in (self._word_ids, self._part_ids))

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        shown = self.letters[np.frombuffer(" ".join(parts).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts):  # a vocabulary without such tokens
            return [np.array([t.id for t in self.tokenizer.model.tokenize(x)], dtype="<u4").tobytes() for x in shown.split(" ")]
        raw, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        texts = pa.array(words, pa.string())
        plain = pc.and_not(pc.match_substring_regex(texts, _PLAIN), pc.match_substring(texts, _SPECIAL))
        cut = pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), _PARTS, r"\0 ")
        out = self.parts.joined(pc.split_pattern(pc.ascii_rtrim_whitespace(cut), " ")).to_numpy(zero_copy_only=False)
        if len(out) == len(words):
            return out.tolist()
        is_plain = plain.to_numpy(zero_copy_only=False)
        hard = texts.filter(pc.invert(plain)).to_pylist()
        every = np.empty(len(words), dtype=object)
        every[is_plain] = out
        every[~is_plain] = [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(hard, add_special_tokens=False)]
        return every.tolist()

    def of(self, texts: pa.ListArray | list[list[bytes]]) -> Iterator[bytes]:
        """The ids of each text's words; the new words of all texts are learned at once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.list_(pa.binary()))
        return iter(self.words.joined(texts).to_numpy(zero_copy_only=False).tolist())


_WORKER: dict[tuple[str, int | None], WordIds] = {}


def _word_ids(path: str, cache: int | None = None) -> WordIds:
    if (path, cache) not in _WORKER:
        _WORKER.clear()  # a worker keeps one cache
        _WORKER[path, cache] = WordIds(path, cache)
    return _WORKER[path, cache]


def token_pieces(docs: DataFrame, path: str, end: int = 1, most: int = 4096, cache: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text: its ids and then `end`, cut into pieces of `most` where longer.

    The tokenizer lowers case, drops white space and never joins across it, so ids are those of the
    text's words one after another, encoded once for each worker and word, of which a worker keeps
    `cache` (CACHE_WORDS if None), and as many parts. Null text counts as empty and gives one piece of length 1.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(path, cache)
        last = np.array([end], dtype="<u4").tobytes()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            row, out, at = [], [], 0
            for texts in text_slices(b, b.num_rows, AT_ONCE * (cache or CACHE_WORDS)):
                words = pc.ascii_split_whitespace(pc.fill_null(texts["text"], ""))
                for i, ids in enumerate(ids_of.of(words.cast(pa.list_(pa.binary()))), at):
                    ids += last
                    for k, begin in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[begin : begin + 4 * most]
                        row.append(i)
                        out.append((k, begin // 4, len(part) // 4, zlib.crc32(part)))
                at += texts.num_rows
            if row:
                numbers = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row, pa.int64())), *numbers], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """Bins that any packing of the lengths needs at least, by dual feasible functions.

    Two families over x = length / most: the threshold functions (1 above 1 - t, x between t and
    1 - t, 0 below t) and the rounding functions (x if (k + 1) x is whole, else floor((k + 1) x) / k).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=most + 1).astype(np.int64)
    size = np.arange(most + 1)
    best = -(-int(count @ size) // most)
    number, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(1, most // 2 + 1)
    big = number[-1] - number[most - t + 1]  # longer than most - t
    middle = mass[most - t + 1] - mass[t]
    best = max(best, int((big - (-middle // most)).max()))
    for k in range(1, 65):
        up = (k + 1) * size
        value = np.where(up % most == 0, k * size, most * (up // most))  # times k * most
        best = max(best, -(-int(count @ value) // (k * most)))
    return best


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing: the bin of each length, and how many bins."""
    bins, used = np.zeros(len(lengths), dtype=np.int64), 0
    room: list[list[int]] = [[] for _ in range(most + 1)]
    mask = 0  # bit r: some bin has r left
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, k, used = most, used, used + 1
        bins[i] = k
        if r > n:
            room[r - n].append(k)
            mask |= 1 << (r - n)
    return bins, used


def _tidy(rows: pd.DataFrame, bins: np.ndarray, used: int, most: int, last: bool) -> pd.DataFrame:
    """rows with bin, offset and open: of a partition over its bound, the pieces of its emptiest bins go to the next exchange."""
    lengths = rows["length"].to_numpy()
    order = np.lexsort((np.arange(len(rows)), bins))
    rows, bins, lengths = rows.iloc[order], bins[order], lengths[order]
    before = np.cumsum(lengths) - lengths
    first = np.r_[True, bins[1:] != bins[:-1]]
    rows = rows.assign(bin=bins, offset=before - np.maximum.accumulate(np.where(first, before, 0)), open=False)
    if not last and used > lower_bound(lengths, most):
        fill, number = np.bincount(bins, lengths, used), np.bincount(bins, minlength=used)
        emptiest = np.argsort(fill, kind="stable")
        give = np.zeros(used, dtype=bool)
        give[emptiest[np.cumsum(number[emptiest]) <= GIVEN]] = True
        give &= fill < most
        rows["open"] = give[bins]
    return rows


def pack(pieces: DataFrame, most: int = 4096) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32; length 1..most) with sequence_id and offset.

    Pieces are dealt by hash to partitions of about GROUP. Each is packed by best-fit decreasing
    and compared with its lower bound: a partition that meets the bound is certified and done. The
    others hand the pieces of their emptiest bins (GIVEN at most, so that an exchange has a size
    bound) to an exchange of MERGED partitions, which repacks them and keeps the better of the new
    and the old packing, and so on until one exchange is left. Repeated rows are packed one by one;
    without rows the result is empty.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    groups = max(1, -(-pieces.count() // GROUP))
    given = pieces.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *columns[1:], F.col("doc_id").isNull().alias("unknown"))  # pandas has no integers beside nulls
    columns = given.columns
    schema = given.schema.simpleString()[7:-1].replace(":", " ") + ", home long, bin long, offset long, open boolean"

    def packer(last: bool):
        def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "unknown", "doc_id", "piece", "start"], ascending=[False, False, True, True, True], kind="stable")
            lengths = rows["length"].to_numpy(dtype=np.int64)
            bins, used = best_fit(lengths, most)
            if "old" in rows:
                old, names = pd.factorize(rows["old"])
                if len(names) < used:
                    bins, used = old, len(names)
            rows = _tidy(rows, bins, used, most, last)
            rows["home"] = key[0]
            return rows[[*columns, "home", "bin", "offset", "open"]]

        return work

    dealt = given.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)).alias("home"))
    done, level = [], 0
    while True:
        packed = stash(dealt.groupBy("home").applyInPandas(packer(groups == 1), schema), "packed")
        number = (F.col("home") * (1 << 30) + F.lit(level << 26) + F.col("bin")).alias("sequence_id")
        done.append(packed.where("not open").select(*columns, number, "offset"))
        if groups == 1:
            break
        groups, level = -(-groups // MERGED), level + 1
        dealt = packed.where("open").select(*columns, F.floor(F.col("home") / MERGED).alias("home"), F.concat_ws(".", "home", "bin").alias("old"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("doc_id", F.when(~F.col("unknown"), F.col("doc_id"))).drop("unknown")


def packed_documents(docs: DataFrame, path: str, end: int = 1, most: int = 4096, cache: int | None = None) -> DataFrame:
    """One row per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset (see token_pieces and pack)."""
    return pack(stash(token_pieces(docs, path, end, most, cache), "pieces"), most)
