"""The language field against enumeration, finite differences, planted code-switching and held-out labels."""

import itertools
import zlib

import numpy as np
import pytest
from tallyfield.llm import language, queries
from tallyfield.llm.language import Field

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, spans string, held_out string"


def small_field(seed=0, k=3):
    r, f = np.random.default_rng(seed), Field([f"l{i}" for i in range(k)])
    for x in ("step", "begin", "lexicon"):
        f.p[x] = r.normal(0, 1, f.p[x].shape)
    for x in ("grams", "affixes"):
        f.p[x] = r.normal(0, 0.5, f.p[x].shape)
        f.p[x][0] = 0
    return f


@pytest.mark.parametrize("block", [1, 2, 64])
def test_marginals_are_those_of_all_paths(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    f, r = small_field(), np.random.default_rng(4)
    e, opens = r.normal(0, 1, (9, 3)), np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    got, pairs = f.marginals(e, opens, pairs=True)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    bounds = [*np.flatnonzero(opens), 9]
    for a, z in itertools.pairwise(bounds):
        paths = list(itertools.product(range(3), repeat=z - a))
        w = np.exp([f.p["begin"][p[0]] + sum(e[a + i, y] for i, y in enumerate(p)) + sum(f.p["step"][x, y] for x, y in itertools.pairwise(p)) for p in paths])
        for p, q in zip(paths, w / w.sum(), strict=True):
            for i, y in enumerate(p):
                want[a + i, y] += q
            for x, y in itertools.pairwise(p):
                want_pairs[x, y] += q
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_gradient():
    f, text = small_field(2), "Ein kleiner Satz und the other word ée"
    f.learn_words([text, text, text], [0, 1, 1])
    codes = language._codes(text)
    start, end = language.words_of(codes)
    gold, opens = np.array([0, 0, 1, 2, 1, 1, 0, 2]), np.array([1, 0, 0, 1, 0, 0, 0, 0], bool)

    def loss():
        e, total = f.emissions(codes, start, end).astype(float), 0.0
        for a, z in ((0, 3), (3, 8)):
            score = lambda p: f.p["begin"][p[0]] + sum(e[a + i, y] for i, y in enumerate(p)) + sum(f.p["step"][x, y] for x, y in itertools.pairwise(p))  # noqa: B023, E731
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=z - a))) - score(tuple(gold[a:z]))
        return total / len(start)

    g = f._gradient(codes, start, end, gold, opens)
    grams, _, _, affixes, _ = language._features(codes, start, end)
    at = {"grams": [(grams[0, 2], 1), (grams[1, 3], 0)], "affixes": [(affixes[0, 0], 2), (affixes[3, 4], 1)], "lexicon": [(0, 1), (1, 1)], "step": [(0, 1), (2, 2)], "begin": [(0,), (2,)]}
    for name, places in at.items():
        for p in places:
            was = f.p[name][p]
            f.p[name][p] = was + 1e-3
            up = loss()
            f.p[name][p] = was - 1e-3
            down = loss()
            f.p[name][p] = was
            assert abs((up - down) / 2e-3 - g[name][p]) < 1e-3, name


def test_features_do_not_depend_on_neighbours():
    f = small_field(3)
    f.learn_words(["abc abc abc naïve naïve naïve"], [1])
    words = ["a", "ab", "abc", "naïve", "ß", "été", "x" * 50]
    one = np.concatenate([f.emissions(language._codes(w), np.array([0]), np.array([len(w)])) for w in words])
    text = "; ".join(words).upper().replace("SS", "ß")
    start, end = language.words_of(language._codes(text))
    assert np.allclose(f.emissions(language._codes(text), start, end), one, atol=1e-5)


def test_words():
    text = "1Ab é-ćd ́x हिन्दी 9"
    assert [text[a:b] for a, b in zip(*language.words_of(language._codes(text)), strict=True)] == ["Ab", "é", "ćd", "x", "हिन्दी"]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language.trained(docs)


def test_held_out_accuracy(spark, fitted):
    docs, field = fitted
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.queries()["op12_language"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.985


def test_code_switched_text(spark, fitted):
    """Words of two documents, ten of each in turn: nearly every word gets its own language, though none was labelled so."""
    docs, field = fitted
    texts = {r.lang: r.text for r in docs.where("n_chars between 2000 and 6000").where(language.held_out()).orderBy("doc_id").collect()}
    right = total = 0
    for a, b in itertools.permutations(sorted(texts), 2):
        parts = [(lang, " ".join(texts[lang].split()[i : i + 10])) for i in range(0, 100, 10) for lang in (a, b)]
        text, truth = "", []
        for lang, part in parts:
            truth.append((len(text), len(text) + len(part), lang))
            text += part + " "
        (row,) = language.language_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).collect()
        assert all(x.end <= y.start for x, y in itertools.pairwise(row.spans))
        for s in row.spans:
            for x, y, lang in truth:
                n = len(text[max(s.start, x) : min(s.end, y)].split()) if min(s.end, y) > max(s.start, x) else 0
                total, right = total + n, right + n * (lang == s.lang)
    assert right / total > 0.97


def test_odd_rows(spark, fitted):
    _, field = fitted
    rows = [(1, None, "en", "s", "h"), (None, "", None, "s", "h"), (2, "123 !", "en", "s", "h"), (3, "the and of", None, "s", "h"), (3, "the and of", None, "s", "h"), (-(2**63), "der und die " * 50_000, "de", "s", "h"), (4, "x" * 300_000, "en", "s", "h")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in language.document_languages(df, field).collect()]
    assert sorted((r[0] is None, r[0], r[2]) for r in got if r[2] == "und") == [(False, 1, "und"), (False, 2, "und"), (True, None, "und")]
    assert all(r[3] == 0 for r in got if r[2] == "und")
    assert [r for r in got if r[0] == 3] == [(3, zlib.crc32(b"3") % 3 == 1, "en", got[3][3])] * 2
    assert next(r for r in got if r[0] == -(2**63))[2] == "de"
    assert len(language.language_spans(df, field).collect()) == len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert language.document_languages(empty).count() == 0
    # nothing to learn from, and one language alone
    alone = spark.createDataFrame([(1, "abc def", None, "", ""), (2, "ghi", None, "", "")], SCHEMA)
    assert {r.lang_pred for r in language.document_languages(alone).collect()} == {"und"}
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1]
    one = spark.createDataFrame([(i, "abc def", "xx", "", "") for i in ids] * 3, SCHEMA)
    assert {(r.lang_pred, r.score) for r in language.document_languages(one).collect()} == {("xx", 1.0)}
