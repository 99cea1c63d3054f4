from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import languages as L
from quillmesh.llm import queries

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def vocabulary():
    return L.vocabulary(L.vocabulary_path())


def segmentations(word: bytes, pieces: dict[bytes, int]):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [pieces[word[:n]], *rest]


WORDS = ["the", "a", "straße", "niño", "zx", "enlightened", "中文"]


def test_forward_and_counts_against_enumeration(vocabulary):
    rng = np.random.default_rng(0)
    p = rng.random((len(vocabulary.pieces), 3)).astype("f4")
    pieces = {x: i for i, x in enumerate(vocabulary.pieces)}
    model = L.LanguageModel(["x", "y", "z"], np.zeros(3), p, L.vocabulary_path())
    got = model.word_scores(WORDS)
    for word, row in zip(WORDS, got, strict=True):
        ways = list(segmentations(b" " + word.encode(), pieces))
        assert len(ways) > 1
        for k in range(3):
            assert row[k] == pytest.approx(math.log(sum(math.prod(float(p[i, k]) for i in way) for way in ways)), rel=1e-5)
    column, weight = np.array([0, 1, 2, 0, 1, 2, 0]), np.array([1.0, 2, 3, 4, 5, 6, 7])
    counts = np.zeros((len(pieces), 3))
    for rows, letters, size in L._batches(L._encoded(WORDS), 2):
        i, k, n = L.expected(vocabulary.found(letters), size, p, column[rows], weight[rows])
        np.add.at(counts, (i, k), n)
    want = np.zeros_like(counts)
    for word, k, w in zip(WORDS, column, weight, strict=True):
        ways = list(segmentations(b" " + word.encode(), pieces))
        chance = np.array([math.prod(float(p[i, k]) for i in way) for way in ways])
        for way, c in zip(ways, chance / chance.sum(), strict=True):
            for i in way:
                want[i, k] += w * c
    assert np.allclose(counts, want)


def test_pieces_are_found(vocabulary):
    word = " über die häuser".encode()
    known = {x: i for i, x in enumerate(vocabulary.pieces)}
    with np.errstate(over="ignore"):
        found = vocabulary.found(np.frombuffer(word, "u1")[None, :])
    for n, row in enumerate(found, 1):
        assert row[0].tolist() == [known.get(word[s : s + n], -1) for s in range(len(word) - n + 1)]


def test_words_of_parts(monkeypatch):
    text = "Ein Wort, 12 Wörter_und é́e " * 50 + "x" * 100
    whole = [w for words in L.words_of(text) for w in words]
    monkeypatch.setattr(L, "PART", 7)
    assert [w for words in L.words_of(text) for w in words] == whole
    assert "é́e" in whole and max(map(len, whole)) == L.LETTERS and "".join(whole[-4:]) == "x" * 100
    assert list(L.words_of(None)) == [] and list(L.words_of("")) == []


def test_long_words_and_kept_words(vocabulary, monkeypatch):
    """Long runs don't underflow, and forgetting words changes nothing."""
    rng = np.random.default_rng(1)
    p = L.smoothed(rng.random((len(vocabulary.pieces), 2)) ** 8)
    model = L.LanguageModel(["a", "b"], np.log([0.5, 0.5]), p, L.vocabulary_path())
    texts = ["ब" * 5000, "word " * 3000, None, "12 34", "once upon a time", "ж" * 31]
    first = L.Scorer(model)
    logs, count = first.logs(texts)
    assert np.isfinite(logs).all() and count.tolist() == [157, 3000, 0, 0, 4, 1]
    again = L.Scorer(model)
    again.most = 2
    assert all(np.allclose(again.logs([t])[0], logs[i]) for i, t in enumerate(texts))


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_on_held_out_documents(spark, d):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op11_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.held_out and letters:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(right) > 40 and np.mean(right) >= 0.97


def test_odd_rows(spark):
    texts = {"en": "the house and the garden of the king", "de": "das haus und der garten des königs", "": "zzz qqq zzz"}
    docs = [(i * 3 + j, t, x) for i in range(30) for j, (x, t) in enumerate(texts.items())]
    odd = [(1000, "the king", None), (None, "the house", "fr"), (1001, None, "en"), (1001, None, "en"), (1002, "", "nl"), (1003, "12 !!", "en"), (1004, "DER GARTEN " * 20_000, None)]
    frame = spark.createDataFrame(docs + odd, DOCS).withColumns({"score": F.lit("s"), "lang_pred": F.lit(1), "language": F.lit(2)})
    model = L.train(frame)
    assert model.languages == ["", "de", "en", "nl"] and np.allclose(model.p.sum(0), 1, atol=1e-3)
    got = L.predict(frame, model)
    assert got.columns == ["doc_id", "text", "lang", "language", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(docs + odd)
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id is not None and r.doc_id < 90)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id is None or r.doc_id >= 1000} == {1000: "en", None: "en", 1001: "und", 1002: "und", 1003: "und", 1004: "de"}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], DOCS)
    model = L.train(none)
    assert L.predict(none, model).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], DOCS)
    assert [(r.lang_pred, r.score) for r in L.predict(one, model).collect()] == [("und", 0.0)]
    dumb = L.train(spark.createDataFrame([(1, "12", "en"), (2, None, "en")], DOCS))
    assert [r.lang_pred for r in L.predict(one, dumb).collect()] == ["en"]
