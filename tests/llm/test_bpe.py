from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmesh.llm import bpe, packing

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
CODECS = bpe.BpeCodec(PATH), packing.LibraryEncoder(PATH)
DOCS = "doc_id long, text string"


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB'st é́\n <|endoftext|>12,.!ΣİŁ", max_size=60)))
def test_like_the_library(text):
    for codec in CODECS:
        assert codec.encode(text) == ids(text)
    assert CODECS[0].decode(ids(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>B <|endoftext|>", "<|endoftext", "it's We'LL 123", "ＡＢＣ ΟΔΟΣ ẞß", "a\x1cb\x85c​d"])
def test_odd_texts(text):
    assert CODECS[0].encode(text) == ids(text)


def test_long_word_takes_no_square_time():
    word = "abcdefgh" * 20_000
    assert CODECS[0].encode(word) == ids(word)


def test_cache_of_two_generations():
    cache = bpe.TwoGenerations(2)
    for i in range(5):
        cache.put(str(i), b"")
    assert len(cache.young) <= 2 and len(cache.old) <= 2
    cache.put("x" * 1000, b"")
    assert "x" * 1000 not in cache.young


def test_frames(spark):
    rows = [(1, "Hello World"), (2, None), (3, ""), (1, "Hello World"), (4, "x " * 5000), (None, "n")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", ids string")
    got = bpe.round_trip(docs).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in got) == sorted((str(d), tuple(ids(t or "")), LIBRARY.decode(ids(t or ""), skip_special_tokens=False)) for d, t in rows)
    encoded = bpe.encode_documents(docs)
    assert sorted(len(r.ids) for r in encoded.collect()) == sorted(len(ids(t or "")) for _, t in rows)
    assert bpe.decode_documents(encoded).filter("doc_id = 3").first().text == ""
    assert bpe.round_trip(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    from quillmesh.llm.queries import op1_bpe_round_trip

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_bpe_round_trip(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        found = ids(texts[r.doc_id])
        said = LIBRARY.decode(found, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
