from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import dedup, sketches
from tests.llm.plain import components, shingles

DOCS = "doc_id long, text string"


def check(spark, rows, k=3, percent=85):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(spark.createDataFrame(rows, DOCS), k, percent).collect()}
    want = {d: (n, c, d == c) for d, (n, c) in components(rows, k, percent).items()}
    assert got == want


def family(rng, n, words, changes):
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_families_copies_and_odd_texts(spark):
    rng = random.Random(5)
    texts = family(rng, 40, 60, 4) + family(rng, 15, 200, 8) + ["same text here now"] * 30 + [None, "", " \n\t", "one", "ONE", "one two", "Ünï one two three", "x " * 3000]
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    rng.shuffle(texts)
    check(spark, [(i * 3 + 1, t) for i, t in enumerate(texts)])


@pytest.mark.parametrize("block", [1024, 8])
def test_blocks_find_what_pairs_find(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(dedup, "BLOCK_MEMBERS", block)
    rng = random.Random(7)
    check(spark, [(i, t) for i, t in enumerate(family(rng, 60, 50, 5))], 3, 80)


def test_one_outlier_in_a_large_bucket(spark, monkeypatch):
    """Members of the largest component meet blocks of the others only."""
    monkeypatch.setattr(dedup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(dedup, "BLOCK_MEMBERS", 4)
    buckets = spark.createDataFrame([(0, 7, n, 0 if n < 30 else n) for n in range(33)], "band int, bucket long, node long, component long")
    sets = spark.createDataFrame([(n, np.arange(n // 31, 40, dtype="u8").tobytes()) for n in range(33)], "node long, shingles binary")
    got = {(r.a, r.b) for r in dedup._block_links(buckets, sets, 90).collect()}
    up = {n: 0 if n < 30 else n for n in range(33)}
    for _ in range(3):
        for a, b in got:
            up[a] = up[b] = min(up[a], up[b])
    assert got and set(up.values()) == {0}


def test_query(spark, sf_dir):
    """Every column against all pairs of the table."""
    from quillmesh.llm.queries import op2_near_duplicates

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2_near_duplicates(spark, sf_dir).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in components(docs, 3, 85).items()}


def test_empty_table_and_repeats(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (2, "z y x w v")]
    got = sorted(map(str, dedup.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", bands int"), 3, 85).collect()))
    assert got == sorted(
        f"Row(doc_id={d}, n_shingles={n}, component_id={c}, kept={k})" for d, n, c, k in [(1, 5, 1, True), (1, 5, 1, True), (None, 5, 1, True), (None, 0, None, True), (2, 3, 2, True)]
    )


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \n\t é.", max_size=40), st.integers(1, 5))
def test_shingle_sets(text, k):
    assert len(sketches.shingle_set(text, k)) == len(shingles(text, k))


def test_estimate_and_signature():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype("u8")
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    x, y = sketches.sketch(a, 512), sketches.sketch(b, 512)
    n = np.array([3000])
    assert abs(sketches.estimated_jaccard(x[None], y[None], n, n, 26)[0] - 0.5) < 0.1
    assert sketches.signature(a) == sketches.signature(a.copy()) != sketches.signature(b)
    assert sketches.expected_collisions(n, n, 128, 10)[0] > 0
    tiny = sketches.sketch(a[:1], 64)
    assert len(set(tiny.tolist())) == 1


def test_band_choice():
    for percent in (50, 80, 85, 95, 100):
        rows, bands = sketches.bands_for(percent)
        assert bands <= 56 and (1 - (percent / 100) ** rows) ** bands <= 1e-7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(1, 12), min_size=1), min_size=1, max_size=8), st.lists(st.sets(st.integers(1, 12), min_size=1), min_size=1, max_size=8), st.integers(30, 100))
def test_matrix_links(x, y, percent):
    array = lambda s: np.array(sorted(s), "u8")
    got = dedup.links_between([array(s) for s in x], [array(s) for s in y], np.ones((len(x), len(y)), bool), percent, width=5)
    assert got.tolist() == [[bool(a & b) and 100 * len(a & b) >= percent * len(a | b) for b in y] for a in x]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.data())
def test_forest_joins_the_same(n, m, data):
    linked = np.array(data.draw(st.lists(st.lists(st.booleans(), min_size=m, max_size=m), min_size=n, max_size=n)))
    a, b = np.arange(n), np.arange(m) + 100

    def parts(edges):
        up = {x: x for x in [*a.tolist(), *b.tolist()]}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in edges:
            up[root(x)] = root(y)
        return {frozenset(k for k in up if root(k) == r) for r in map(root, up)}

    every = [(int(a[i]), int(b[j])) for i in range(n) for j in range(m) if linked[i, j]]
    assert parts(zip(*dedup._forest(linked, a, b), strict=True)) == parts(every)
