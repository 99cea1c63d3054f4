from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import neighbours as N

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k):
    """Only rows that take part."""
    out = {}
    for q, a in rows:
        if q % 100 == 0:
            others = sorted((math.dist(a, b), v) for v, b in rows if v != q)
            out[q] = [v for _, v in others[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_odd_vectors_and_ties(spark):
    good = [(i, [float(i % 5), 1.0]) for i in range(230)]
    bad = [(1000, None), (1100, [0.0, 0.0]), (1200, [1.0, None]), (1300, [float("nan"), 1.0]), (1400, [float("inf"), 1.0]), (1500, [1.0]), (1600, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in good + bad], VECTORS + ", tree int")
    assert found(N.nearest(df, F.col("vec_id") % 100 == 0)) == brute(good, 10)


def test_few_none_and_one_vector(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], VECTORS)
    assert found(N.nearest(few, F.col("vec_id") % 100 == 0)) == {0: [1]}
    assert N.nearest(few.filter("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0
    assert N.nearest(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], VECTORS)
    got = found(N.nearest(same, F.col("vec_id") % 100 == 0, block=50))
    assert got[0] == list(range(1, 11)) and got[500] == list(range(10))


@pytest.mark.parametrize(("query_block", "block"), [(2048, 400), (3, 200)])
def test_recall_and_scores(spark, query_block, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    got = N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, block=block, query_block=query_block).cache()
    want = brute(rows, 10)
    mine = found(got)
    assert set(mine) == set(want)
    assert np.mean([len(set(mine[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    at = dict(rows)
    for r in got.collect():
        assert abs(r.score - math.dist(at[r.query_id], at[r.vec_id])) < 1e-9
    got.unpersist()


@pytest.mark.parametrize(("sf", "most"), [("sf0.001", 0.75), ("sf0.1", 0.65)])
def test_query(spark, sf, most):
    """Recall against brute force, exact scores and order, and the share of rows that a query looks at."""
    from quillmesh.llm.queries import op5_nearest_vectors

    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in table]
    got = op5_nearest_vectors(spark, f"/root/testdata/{sf}").collect()
    at, want = dict(rows), brute(rows, 10)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        assert abs(r.score - math.dist(at[r.query_id], at[r.vec_id])) < 1e-12
        mine.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(mine) == set(want) and all(x == sorted(x) and len(x) == 10 for x in mine.values())
    assert np.mean([len({v for _, v in mine[q]} & set(want[q])) / 10 for q in want]) >= 0.9

    x = np.array([v for _, v in rows])
    rng = np.random.default_rng(N.SEED)
    forest = N.Forest([N.grow(x, N.LEAF, rng) for _ in range(N.TREES)])
    own = forest.leaves(x)
    seen = [np.any([own[:, t] == leaf for t, leaf in forest.probes(x[i], N.BUDGET * len(x) ** N.POWER)], 0).mean() for i, (v, _) in enumerate(rows) if v % 100 == 0]
    assert np.mean(seen) <= most


def test_a_common_vector_and_long_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [0.5, 0.25] if i % 3 == 0 else rng.normal(size=2).round(1).tolist()) for i in range(901)]
    df = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>")
    got = found(N.nearest(df, F.col("vec_id") % 100 == 0, block=100))
    want = brute(rows, 10)
    assert got[300] == want[300] == [i for i in range(0, 33, 3)][:10] and set(got) == set(want)
    long = [(i, rng.normal(size=5000).tolist()) for i in range(12)]
    assert found(N.nearest(spark.createDataFrame(long, VECTORS), F.col("vec_id") % 100 == 0))[0]


def test_probes_open_the_nearest_first():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    forest = N.Forest([N.grow(x, 20, rng) for _ in range(3)])
    leaves = forest.leaves(x)
    own = forest.probes(x[0], 1)
    assert own[0][1] == leaves[0, own[0][0]]
    every = forest.probes(x[0], 10**9)
    assert len(every) == len(set(every)) == sum(len(t.sizes) for t in forest.trees)
