from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import quality as Q

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    field = Q.LineField(rng.normal(size=3), rng.normal(size=(2, 2)), (0.0, 1.0))
    counts = np.array([1, 4, 2, 5, 1])
    x = rng.normal(size=(counts.sum(), 3))
    got = field.marginals(x, counts)
    at = 0
    for n in counts:
        odds = x[at : at + n] @ field.weights
        total, good = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(o for o, s in zip(odds, states, strict=True) if s) + sum(field.transitions[a, b] for a, b in itertools.pairwise(states)))
            total += weight
            good += weight * np.array(states)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_features_are_per_text():
    texts = ["Plain words here.\nSHOUT!! NOW!!", None, "", "\n\n", "a a a a\né É 1|2", "x" * 5000]
    joint, size, counts = Q.line_features(texts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        own, own_size, own_counts = Q.line_features([t])
        assert own_counts.tolist() == [n] and np.allclose(own, joint[at : at + n]) and np.allclose(own_size, size[at : at + n])
        at += n


@pytest.mark.parametrize("seed", [0, 1, 4, 7, 9, 13, 20])
def test_fit_of_classes_that_lie_apart(seed):
    """Groups of like lines and some far out, on which whole Newton steps grow without bound."""
    rng = np.random.default_rng(seed)
    kind, far = rng.integers(0, 6, 4000), rng.random(4000) < 0.01
    x = np.hstack([np.ones((4000, 1)), rng.normal(0, 4, (6, 5))[kind] + rng.normal(0, 0.1, (4000, 5))])
    x[far, 1:] *= 20
    y = ((kind < 2) & ~far).astype(float)
    for penalty in (0.1, 1e-3):
        w = Q._logistic(x, y, penalty)
        slope = x.T @ (Q._sigmoid(x @ w) - y) + penalty * w
        assert np.abs(slope).max() < 1e-3 and np.abs(w).max() < 100


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = Q.train(docs, labels)
    scores = {r.doc_id: r.score for r in Q.score_documents(docs.select("doc_id", "text"), field).collect()}
    out = [(scores[r.doc_id] >= Q.KEEP_FROM) == (r.quality == 1) for r in labels.collect() if Q.is_held_out(r.doc_id)]
    assert len(out) > 40 and np.mean(out) >= 0.97
    assert len(scores) == docs.count()


def test_folds_agree(spark):
    got = spark.range(300).select("id", Q.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == Q.is_held_out(r.id) for r in got)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 7), (2, None), (None, 1)], 0.5)])
def test_without_two_classes(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (3, None)], DOCS)
    field = Q.train(docs, spark.createDataFrame(labels, LABELS))
    if labels == [(1, 1), (2, 1)] and all(Q.is_held_out(d) for d, _ in labels):
        score = 0.5
    assert [r.score for r in Q.score_documents(docs, field).collect()] == [score] * 4


def test_empty_clash_and_contradiction(spark):
    docs = spark.createDataFrame([(i, "GOOD words in a row.\nmore of them." if i % 2 else "BAD!! BAD!! BAD!!\n### $$$ BAD!!", 9.0) for i in range(60)], DOCS + ", score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (1, 1), (1, 1)], LABELS)
    field = Q.train(docs, labels)
    got = Q.score_documents(docs, field)
    assert got.columns == ["doc_id", "text", "score"]
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got.collect())
    assert Q.score_documents(spark.createDataFrame([], DOCS), field).count() == 0
    assert 0 <= field.score([None, "", "\n" * 3000])[0] <= 1
