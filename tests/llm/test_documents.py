"""Dedup, joins, packing, counting, scoring and mixing against brute force, with the odd cases."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tallyfield.llm import components, exact, jaccard, mixing, packing, passages, quality, tokens
from tallyfield.llm.queries import tokenizer_file
from tallyfield.llm.shingles import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(["the", "lorn", "Abath", "trenn", "ouved", "is", "mar", "Quell", "éaux", "ÉTAT"]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    base = prose(r, 120)
    w = base.split()
    near = []
    for k in range(12):
        v = list(w)
        for _ in range(k % 6):
            v[r.randrange(len(v))] = f"new{r.random()}"
        near.append(" ".join(v))
    long = prose(r, 30_000)
    return [None, "", " \n\t", "A", "a", "one two", "One TWO", base, base.upper(), base, *near, long, long + " tail", "ß İ K", "SS İ k", "  a  b ", "a\u00a0b", *(prose(r, 60) for _ in range(20))]


def same_texts(texts):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [(t or "").translate(table) for t in texts]


def test_exact_dedup(spark, odd_texts):
    groups = defaultdict(list)
    for i, t in enumerate(same_texts(odd_texts)):
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact.exact_dedup(docs_of(spark, odd_texts), runs=16).collect()}
    assert len(got) == len(odd_texts)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact.keep_one(docs_of(spark, odd_texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {max(i) for i in groups.values()}


def test_exact_dedup_odd_rows(spark):
    rows = exact.exact_dedup(docs_of(spark, ["x", "X", "y", "y", None], [None, 5, -3, -3, None])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["kept"]) for r in rows if r["keep_id"] is not None) == [(False, -3, -3, True), (False, -3, -3, True), (False, 5, 5, True), (True, 0, 5, False)]
    assert exact.exact_dedup(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, ["p", "P"]).selectExpr("*", "'z' as digest", "1 as run", "2 as best", "3 as norm", "4 as n")
    assert exact.exact_dedup(clash).where("kept").count() == 1


def sets_of(texts, k):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def grouped(ids, linked):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {i: root(i) for i in ids}


def test_keep_one_drops_rows_not_ids(spark):
    docs = docs_of(spark, ["one text", "ONE text", "other text", "one text", None, ""], [None, 5, 5, 9, None, 3])
    assert sorted((x["doc_id"], x["text"]) for x in exact.keep_one(docs).collect()) == [(3, ""), (5, "other text"), (9, "one text")]


def brute_join(texts, k, percent):
    sets = sets_of(texts, k)
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, grouped(range(len(sets)), links)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_similar_documents(spark, odd_texts, k, percent):
    sets, label = brute_join(odd_texts, k, percent)
    got = {r["doc_id"]: r for r in jaccard.similar_documents(docs_of(spark, odd_texts), k, percent).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: r["component_id"] for i, r in got.items()} == label


def test_similar_documents_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets, label = brute_join([r["text"] for r in rows], 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in label}
    assert len(set(label.values())) < len(label)


def test_similar_documents_large_group_without_hub(spark):
    """A chain of texts, each linked with the next only, and a hub that links with all copies of it."""
    r = random.Random(8)
    w = prose(r, 200).split()
    chain = []
    for i in range(0, 60, 3):
        w = w[:i] + [f"c{i}{j}" for j in range(3)] + w[i + 3 :]
        chain.append(" ".join(w))
    hub = prose(r, 150).split()
    star = [" ".join(hub[:i] + [f"s{i}"] + hub[i + 1 :]) for i in range(0, 150, 3)] + [" ".join(hub)] * 3
    texts = chain + star
    _, label = brute_join(texts, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs_of(spark, texts)).collect()} == label


def test_similar_documents_odd_rows(spark):
    assert jaccard.similar_documents(docs_of(spark, [])).count() == 0
    rows = jaccard.similar_documents(docs_of(spark, ["a b c d e f", "a b c d e f", None, "g h i j k"], [7, 7, 8, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_shingles"]) for r in rows) == [(-1, -1, 2), (7, 7, 3), (7, 7, 3), (8, 8, 0)]
    twice = jaccard.similar_documents(docs_of(spark, ["a b c d e", "v w x y z", "v w x y z"], [1, 1, 0])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in twice) == [(0, 0), (1, 0), (1, 1)]
    stay = jaccard.one_of_each_group(docs_of(spark, ["a b c d e f", "A b c d e f", ""]).selectExpr("*"))
    assert sorted(r["doc_id"] for r in stay.collect()) == [0, 2]


def test_similar_documents_hot_keys_and_split_groups(spark, monkeypatch, odd_texts):
    """Keys of three postings already count as hot, and a set is compared with two partners in a group."""
    from tallyfield.llm import components, verify

    monkeypatch.setattr(components, "HOT", 3)
    monkeypatch.setattr(verify, "SPREAD", 2)
    _, label = brute_join(odd_texts, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs_of(spark, odd_texts)).collect()} == label


def test_similar_documents_null_ids_link(spark):
    w = [f"w{i}" for i in range(80)]
    near = [" ".join(w), " ".join([*w[:40], "new", *w[41:]])]
    far = [" ".join(f"v{i}" for i in range(50)), " ".join(f"v{i}" for i in range(51))]
    rows = jaccard.similar_documents(docs_of(spark, [*near, *far], [None, 5, None, None])).collect()
    assert sorted((r["n_shingles"], r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(47, 0, 0), (48, 0, 0), (77, 0, 5), (77, 5, 5)]
    least = jaccard.similar_documents(docs_of(spark, near, [-(2**63), 5])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in least} == {(-(2**63), -(2**63)), (5, -(2**63))}


def test_outlines_bound_the_difference_of_sets():
    r = np.random.default_rng(3)
    for _ in range(300):
        base = r.integers(0, 2**64, r.integers(1, 400), dtype=np.uint64)
        x, y = (np.unique(np.r_[base[: r.integers(0, len(base) + 1)], r.integers(0, 2**64, r.integers(1, 60), dtype=np.uint64)]) for _ in range(2))
        assert jaccard._apart(jaccard._outline(x), jaccard._outline(y)) <= len(np.setxor1d(x, y))


def test_band_keys_lose_no_short_pair():
    """Sets of SHORT shingles or fewer that are alike share a key, and sketches bound the sets' difference."""
    r, n = np.random.default_rng(1), 0
    x = r.integers(0, 2**64, 4000, dtype=np.uint64)
    for _ in range(400):
        size = int(r.integers(1, 32))
        one = x[r.choice(4000, size, replace=False)]
        two = np.r_[one[r.random(size) > 0.08], x[r.choice(4000, int(r.integers(0, 4)), replace=False)], one[:1]]
        both = np.r_[one, two, one[:3]]
        low, high = np.array([0, len(one)]), np.array([len(one), len(one) + len(two)])
        sizes, sketch, wide, counts, keys = passages._band_keys(both, low, high, 80)
        a, b = set(one.tolist()), set(two.tolist())
        assert sizes.tolist() == [len(a), len(b)] and len(keys) == counts.sum()
        assert bin((int(sketch[0]) ^ int(sketch[1])) & 0xFFFFFFFF).count("1") <= len(a ^ b)
        assert bin((int(wide[0]) ^ int(wide[1])) & (2**64 - 1)).count("1") <= len(a ^ b)
        if 100 * len(a & b) >= 80 * len(a | b) and max(len(a), len(b)) <= passages.SHORT:
            n += 1
            assert set(keys[: counts[0]].tolist()) & set(keys[counts[0] :].tolist())
    assert n > 100


def test_passages_of_long_runs_only(spark):
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    header, passage = line(12), " ".join(line(13) for _ in range(5))
    texts = [header + "\n" + line(40), header + "\n" + line(50) + " " + passage, line(30) + " " + passage + " " + line(20)]
    assert {x["doc_id"] for x in passages.repeated_passages(docs_of(spark, texts)).collect()} == {0, 1, 2}
    rows = passages.repeated_passages(docs_of(spark, [*texts, texts[0][:40]], [0, None, 2, 3]), run=30).collect()
    assert {x["doc_id"] for x in rows} == {None, 2} and all(x["keep_doc_id"] == 2 and x["removed"] == (x["doc_id"] is None) for x in rows)


def test_passages(spark):
    r = random.Random(4)
    sentence = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(n)) + "."
    passage = sentence(25) + " " + sentence(30)
    changed = passage.split()
    changed[-1] = "other."
    texts = [sentence(20) + " " + sentence(15), sentence(14) + " " + passage + "\n" + sentence(18), sentence(30) + "\n" + passage, sentence(5) + " " + " ".join(changed), None, "", "x " * 5000]
    rows = passages.repeated_passages(docs_of(spark, texts)).collect()
    assert {x["doc_id"] for x in rows} == {1, 2, 3}
    for x in rows:
        part = texts[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert len(part.split()) == x["n_words"] and part[:-8] in passage
    by = defaultdict(list)
    for x in rows:
        by[x["component_id"]].append(x)
    assert sorted(len(x) for x in by.values()) == [3, 3]
    assert all(sum(not x["removed"] for x in g) == 1 and {x["keep_doc_id"] for x in g} == {1} for g in by.values())
    assert passages.repeated_passages(docs_of(spark, [])).count() == 0
    twice = passages.repeated_passages(docs_of(spark, [passage, passage], [None, 4])).collect()
    assert {(x["doc_id"], x["removed"]) for x in twice} == {(4, False), (None, True)}


def test_passages_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    units = []
    for row in docs.collect():
        for n, (_, _, w) in enumerate(passages.paragraphs(row["text"])):
            units.append(((row["doc_id"], n), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}))
    holders = defaultdict(list)
    for i, (_, s) in enumerate(units):
        for x in s:
            holders[x].append(i)
    pairs = {(i, j) for h in holders.values() for i, j in itertools.combinations(h, 2)}
    links = [(i, j) for i, j in pairs if 100 * len(units[i][1] & units[j][1]) >= 80 * len(units[i][1] | units[j][1])]
    label = grouped(range(len(units)), links)
    size = Counter(label.values())
    want = {units[i][0] for i in label if size[label[i]] > 1}
    got = {(x["doc_id"], x["number"]) for x in passages.repeated_passages(docs).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def shared_words(docs, rows, run=50):
    """Of (doc_id, text): how many words lie in runs that another document shares, and how many of them the rows cover."""
    places = {i: [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t in docs}
    holders = defaultdict(set)
    for i, w in places.items():
        for k in range(len(w) - run + 1):
            holders[tuple(x.encode().lower() for _, x in w[k : k + run])].add(i)
    want = {(i, at) for i, w in places.items() for k in range(len(w) - run + 1) if len(holders[tuple(x.encode().lower() for _, x in w[k : k + run])]) > 1 for at, _ in w[k : k + run]}
    got = {(x["doc_id"], at) for x in rows for at in range(x["start"], x["start"] + x["length"])}
    return len(want), len(want & got)


def test_passages_of_short_lines_at_any_offset(spark):
    r = random.Random(6)
    lines = lambda n: "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 6))) for _ in range(n))
    shared, one, two = lines(60), lines(40), prose(r, 80)
    inside = prose(r, 45) + " " + prose(r, 70)
    texts = [one + "\n" + shared + "\n" + two, two[:200] + ". " + shared, prose(r, 90) + " " + inside + " " + prose(r, 90), prose(r, 33) + " " + inside + " " + prose(r, 120), "a b. c d. e f. g h", lines(30)]
    rows = passages.repeated_passages(docs_of(spark, texts)).collect()
    n, covered = shared_words(list(enumerate(texts)), rows)
    assert n > 500 and covered >= 0.85 * n
    assert {x["doc_id"] for x in rows} == {0, 1, 2, 3}
    alone = " ".join(f"v{k}" for k in range(24)) + " of" * 300
    assert not passages.repeated_passages(docs_of(spark, [alone, lines(40)]), 30).count()
    for x in rows:  # what is kept is whole: nothing of it is removed in its own component
        same = [y for y in rows if (y["component_id"], y["doc_id"]) == (x["component_id"], x["doc_id"]) and y["start"] < x["start"] + x["length"] and x["start"] < y["start"] + y["length"]]
        assert len({y["removed"] for y in same}) == 1


def test_every_word_is_in_a_unit():
    r = random.Random(7)
    for _ in range(200):
        text = "".join(f"w{r.randrange(50)}" + r.choice([" ", " ", ". ", "\n", "! ", "  ", ".\n\n"]) for _ in range(r.randrange(120)))
        units = passages.paragraphs(text)
        assert all(len(w) >= 10 and words(text[at : at + n]) == w for at, n, w in units) and len({u[:2] for u in units}) == len(units)
        seen = {i for at, n, _ in units for i in range(at, at + n)}
        assert len(words(text)) < 10 or all(m.start() in seen for m in re.finditer(r"\S+", text))


def test_passages_recall_against_shared_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    n, covered = shared_words([(x["doc_id"], x["text"]) for x in docs.collect()], passages.repeated_passages(docs).collect())
    assert n > 10_000 and covered >= 0.9 * n


def test_token_counts(spark, odd_texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = [*odd_texts, "\n", " ", "  ", "a\n\n b", " \n ", "▁a▁▁b ", "x  \n  y\t\tz", "<s> </s> <unk>", "a\r\nb", "tail ", "\n\na", "日本語 テキスト", "\x00 a", "🙂🙂 ok"]
    got = {r["doc_id"]: r for r in tokens.token_counts(docs_of(spark, texts), tokenizer_file("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096), t
    assert tokens.token_counts(docs_of(spark, []), tokenizer_file("piece_bpe_32k.model")).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r["doc_id"]: len(sp.encode(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, tokenizer_file("piece_bpe_32k.model")).collect()} == whole


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check_packing(rows, texts):
    want = {}
    for i, ids in enumerate(ids_of(texts)):
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), [n for _, n, _ in want.values()]


def test_packing(spark, odd_texts):
    texts = [*odd_texts, "<|endoftext|> it's <|startoftext|>x", "don't\u00a0STOP\x1cnow", "e\u0301te\u0301 12345 !?", "İstanbul ǅ"]
    rows = packing.packed_documents(docs_of(spark, texts), tokenizer_file("word_bpe_49k.json")).collect()
    n, lengths = check_packing(rows, texts)
    assert n <= packing.lower_bound(np.array(lengths), 4096) + 1
    assert packing.packed_documents(docs_of(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0
    twice = packing.packed_documents(docs_of(spark, ["a b", "a b", None], [1, 1, None]), tokenizer_file("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["length"], r["offset"]) for r in twice)[0][1] == 1 and len({r["offset"] for r in twice}) == 3


def test_quality_is_not_fitted_on_the_driver(spark, monkeypatch):
    """Texts to learn from stay with the tasks: a driver that cannot fit gets the network all the same."""
    def no(*_, **__):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(quality.ByteNet, "fit", no)
    docs = docs_of(spark, [("good words here " if i % 2 else "%%% ### ") * 20 for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality.trained(docs, labels)
    assert net.score(["good words here " * 20])[0] > 0.5 > net.score(["%%% ### " * 20])[0]
    assert (quality.trained(docs, labels.where("quality = 1")).p["k"] == quality.ByteNet(7).p["k"]).all()


def test_word_ids_are_learned_once(monkeypatch):
    """A frequent word stays known however many rare ones come by; ids are the tokenizer's all along."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    ids, learned = packing.WordIds(tokenizer_file("word_bpe_49k.json")), []
    learn = ids.words.learn
    ids.words.learn = lambda new: learned.extend(new) or learn(new)
    texts = [f"the Caf\u00e9's rare{i} <|x|>{i} n\u00baw" for i in range(60)]
    got = [b for t in texts for b in ids.of([t.encode().split()])]
    assert got == [np.array(x[:-1], "<u4").tobytes() for x in ids_of(texts)]
    assert learned.count(b"the") == 1 and len(learned) == 123


def test_words_of_a_slice_are_looked_up_once(monkeypatch):
    """However often a word comes up in a slice of texts, its ids are looked up once; more words than a half holds leave ids and bound as they are."""
    ids, asked = packing.WordIds(tokenizer_file("word_bpe_49k.json"), 40), []
    of = ids.words.of
    monkeypatch.setattr(ids.words, "of", lambda keys: asked.append(keys.to_pylist()) or of(keys))
    texts = ["the The the's", "", " \n", "x1 \u00c9t\u00e9! " * 50 + "<|endoftext|>", *(f"the rare{i} n\u00baw{i} {i}!?" for i in range(60)), "the"]
    rows = pc.ascii_split_whitespace(pa.array(["left out", *texts, "left out"])).slice(1, len(texts)).cast(pa.list_(pa.binary()))
    assert list(ids.of(rows)) == [np.array(x[:-1], "<u4").tobytes() for x in ids_of(texts)]
    assert [sorted(x) for x in asked] == [sorted({w for t in texts for w in t.encode().split()} | {b""})]
    assert max(len(k) for c in (ids.words, ids.parts) for k in (c.young, c.old)) <= 20
    assert list(ids.of([])) == [] and list(ids.of([[], []])) == [b"", b""]


def test_pipeline_workers_stay_small(spark):
    """In the pipeline a worker gets few rows at a time and keeps the ids of few words; the session is left as it was."""
    pipeline = pytest.importorskip("corpus_pipeline")
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    sized = lambda batches: (b.slice(0, 1).set_column(0, "id", pa.array([b.num_rows])) for b in batches)
    with pipeline.small_batches(spark):
        seen = [r["id"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sized, "id long").collect()]
    assert seen == [1000] * 5 and spark.conf.get(key) == before
    ids = packing.WordIds(tokenizer_file("word_bpe_49k.json"), 40)
    texts = [f"some rare{i} words" for i in range(300)]
    assert [b for t in texts for b in ids.of([t.encode().split()])] == [np.array(x[:-1], "<u4").tobytes() for x in ids_of(texts)]
    assert max(len(k) for c in (ids.words, ids.parts) for k in (c.young, c.old)) <= 20
    docs = docs_of(spark, texts)
    wide, slim = ({tuple(r) for r in packing.packed_documents(docs, tokenizer_file("word_bpe_49k.json"), cache=n).collect()} for n in (None, 40))
    assert wide == slim


def test_repeats_are_counted_in_place():
    """The counts of a block are np.unique's, at a fraction of its memory."""
    for x in ([], [5], [5, 5], [1, 2, 3], [3, 1, 3, 2**64 - 1, 0, 3, 0, 2**64 - 1]):
        x = np.array(x, np.uint64)
        value, n = np.unique(x, return_counts=True)
        got = jaccard._counted(x.copy())
        assert got[0].tolist() == value[n > 1].tolist() and got[1].tolist() == n[n > 1].tolist()
    x = np.random.default_rng(1).integers(0, 2**64, 1_000_000, dtype=np.uint64)
    tracemalloc.start()
    jaccard._counted(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes  # np.unique takes several times as much


def test_packing_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 300)
    r = random.Random(1)
    lengths = [r.choice([r.randrange(1, 700), r.randrange(1300, 1500), r.randrange(1900, 2300), 4096]) for _ in range(4000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(4000))
    fill = Counter()
    for x in rows:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 4096
    one_place = packing.best_fit(np.array(lengths), 4096)[1]
    assert len(fill) <= one_place * 1.01 + 1


def test_bounds_hold():
    r = np.random.default_rng(2)
    for _ in range(200):
        lengths = r.integers(1, 101, r.integers(1, 9))
        best = len(lengths)
        for order in itertools.permutations(lengths.tolist()) if len(lengths) < 7 else [lengths.tolist()]:
            bins, used = 0, 101
            for n in order:
                if used + n > 100:
                    bins, used = bins + 1, 0
                used += n
            best = min(best, bins)
        assert packing.lower_bound(lengths, 100) <= best
        bins, n = packing.best_fit(lengths, 100)
        assert max(Counter({b: int(lengths[bins == b].sum()) for b in range(n)}).values()) <= 100
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[i]["score"], y) for i, y in known.items() if got[i]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs_of(spark, [None, "", "x" * 100_000, "é" * 300], [1, 2, None, 4]).selectExpr("*", "1 as score", "2 as quality"), none).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.accepted(docs_of(spark, []), none).count() == 0
    parts = quality.chunks_of("é" * 5000)
    raw = ("é" * 5000).encode()
    step = quality.CHUNK - quality.SHARED
    assert all(bytes(p[p != quality.PAD].astype(np.uint8)) == raw[i * step : i * step + quality.CHUNK] for i, p in enumerate(parts))
    assert (len(parts) - 1) * step + quality.CHUNK >= len(raw)


def test_mixing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    targets = {"plain": 0.7, "rough": 0.2, "toxic": 0.1}
    rows = mixing.mixed_rates(docs, mixing.label_domains(labels), targets).toPandas()
    assert sorted(rows["doc_id"]) == list(range(1000)) and (rows["rate"] >= 0).all()
    assert rows["n_tokens"].tolist() == [len(words(t)) for t in rows.merge(docs.toPandas(), on="doc_id")["text"]]
    total = rows["n_tokens"].sum()
    for d, t in targets.items():
        assert abs((rows["n_tokens"] * rows["rate"] * rows[f"p_{d}"]).sum() / total - t) < 1e-3
    known = rows.merge(mixing.label_domains(labels).toPandas(), on="doc_id")
    assert (known[["p_plain", "p_rough", "p_toxic"]].to_numpy().argmax(1) == known["domain"].map({"plain": 0, "rough": 1, "toxic": 2})).mean() > 0.85
    assert (np.abs(rows["copies"] - rows["rate"]) < 1).all()


def test_mixing_odd_rows(spark):
    labelled = spark.createDataFrame([(1, "plain"), (2, "toxic")], "doc_id long, domain string")
    docs = docs_of(spark, ["good word", "bad word", None, "", "word word"], [1, 2, 3, None, 1])
    rows = mixing.mixed_rates(docs, labelled).collect()
    assert len(rows) == 5 and all(abs(r["p_plain"] + r["p_rough"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
    assert mixing.mixed_documents(docs, labelled).columns == docs.columns
    assert mixing.mixed_rates(docs_of(spark, []), labelled).count() == 0
    assert mixing.mixed_rates(docs, labelled.limit(0)).where("rate < 0").count() == 0


def test_packing_ids_at_the_ends_of_the_range(spark):
    low, high = -(2**63), 2**63 - 1
    docs = spark.createDataFrame([(low, "a b"), (None, "c"), (high, None), (0, "a b"), (None, None)], "doc_id long, text string")
    got = packing.packed_documents(docs, tokenizer_file("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["length"]) for r in got) == [(False, low, 3), (False, 0, 3), (False, high, 1), (True, 0, 1), (True, 0, 2)]


def test_crowded_keys_with_wide_sketches(spark, monkeypatch):
    """Variants of a passage that mostly just miss the threshold: the same repeats whether pairs across components pass wide sketches or not."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(r.choice([1, 1, 2])):
            words[r.randrange(40)] = f"x{r.randrange(6)}"
        rows.append((i if i % 9 else None, " ".join(words) + ".\n" + " ".join(f"own{i}_{k}" for k in range(15))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "start", "length", "component_id", "copies", "removed"]
    found = []
    for crowd in (10**9, 1):
        monkeypatch.setattr(components, "CROWD", crowd)
        found.append(sorted((tuple(x) for x in passages.repeated_passages(docs).select(columns).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) > 10
