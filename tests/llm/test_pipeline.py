"""The pipeline against plain Python, stage by stage and as a whole."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import quality, secrets
from quillmesh.llm.bpe import vocabulary_path
from tests.llm.plain import base_spans, components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_have_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "secret scans", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    field = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [d for d in sorted(rows) if field.score([rows[d].text])[0] >= quality.KEEP_FROM]
    found = components([(d, rows[d].text) for d in good], 5, 80)
    kept = [d for d in good if found[d][1] == d]

    now = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], (good, kept, kept), strict=True):
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        assert now.columns == docs.columns
        assert sorted(r.doc_id for r in now.collect()) == want
    texts = {r.doc_id: r.text for r in now.collect()}
    for d in kept:
        if base_spans(rows[d].text):
            assert secrets.MARK in texts[d] and not base_spans(texts[d])
        elif secrets.MARK not in texts[d]:
            assert texts[d] == rows[d].text

    library = Tokenizer.from_file(vocabulary_path())
    packed = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        packed.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(packed) == set(kept)
    for d in kept:
        ids = np.frombuffer(b"".join(x for _, x in sorted(packed[d])), "<u4").tolist()
        assert ids == [*library.encode(texts[d], add_special_tokens=False).ids, 2]


def test_odd_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (2, "", None, None, None), (None, "a b", "en", "s", 3), (4, "same words are here again", "en", "s", 5), (5, "same words are here again", "en", "s", 5)]
    extra = spark.createDataFrame([(*r, 1.0) for r in rows], schema.add("score", "double") if "score" not in schema.names else schema)
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 2, 4, None}
    extra.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
