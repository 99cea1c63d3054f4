from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import negatives as N
from quillmesh.llm import queries
from tests.oracle import compare, connection

ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows: list[tuple]) -> set[tuple]:
    """Rows of (vec_id, vector, label), every pair compared in whole numbers."""
    whole = [(v, [math.floor(256 * c) for c in x], y) for v, x, y in rows]
    out = set()
    for a, ax, ay in whole:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(ax, bx, strict=True)), b, by) for b, bx, by in whole if b != a]
        for p, positive, _ in sorted(s for s in scored if s[2] == ay)[:5]:
            fit = sorted((s, b) for s, b, by in scored if by != ay and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out |= {(a, positive, rank, b, -p, -s) for rank, (s, b) in enumerate(fit, 1)}
    return out


def mined(spark, rows, **more) -> set[tuple]:
    got = N.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 100 == 0, F.col("label"), **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("spread,block", [(0.0, 64), (1.5, 64), (1.5, None), (0.0, 7)])
def test_against_every_pair(spark, spread, block):
    rng = np.random.default_rng(int(10 * spread) + (block or 0))
    x = rng.normal(0.1, 0.4, (600, 6)) * np.exp(rng.normal(0, spread, (600, 1)))
    x[100:300] = x[100]  # a vector that a third of the rows repeat, and so ties
    label = np.where(rng.random(600) < 0.4, 3, rng.integers(0, 9, 600))
    rows = [(i, v, int(y)) for i, (v, y) in enumerate(zip(x.tolist(), label, strict=True))]
    assert mined(spark, rows, block=block) == brute(rows)


def test_buckets_are_skipped():
    """Steps that can't reach a window's limit or the running scores are not multiplied."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 8)) * np.exp(rng.normal(0, 1.5, (4000, 1))) * 256).astype("i4")
    norms, ids, labels = np.linalg.norm(x.astype("f8"), axis=1), np.arange(4000), rng.integers(0, 2, 4000)
    ask = N.Asking(ids[:20], labels[:20], x[:20], norms[:20], np.full((20, 1), N._NONE), np.full((20, 1), np.iinfo("i8").max), np.full((20, 1), N._NONE))
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            out = np.asarray(self) @ np.asarray(other)
            seen.append(out.size)
            return out

    ask.x = x[:20].view(Counted)
    a, w, i, s = N.search_block(ask, ids, labels, x, norms, 5, True, step=50)
    assert sum(seen) < 0.5 * 20 * 4000
    for n in range(20):
        mine = sorted((-int(x[n].astype("i8") @ x[j].astype("i8")), j) for j in range(4000) if j != n and labels[j] == labels[n])[:5]
        assert [(-sc, j) for sc, j in zip(s[a == n].tolist(), i[a == n].tolist(), strict=True)] == mine


def test_rows_that_take_no_part(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)], rng.randrange(2)) for i in range(150)]
    odd = [(200, None, 1), (201, [1.0, None, 0.0], 1), (300, [float("nan")] * 3, 0), (301, [float("inf"), 0.0, 0.0], 0), (400, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (401, [1.0], 1), (500, [1e300, 0.0, 0.0], 1), (501, [1e9, 1e9, 0.0], 1)]
    zero = [(600, [0.0, 0.0, 0.0], 1)]
    twice = [(i, [x + 5.0 for x in v], 7) for i, v, _ in rows[:10]] + rows[:5]
    got = mined(spark, rows + odd + zero + twice)
    assert got == brute(rows + zero)
    assert {r[0] for r in got} >= {0, 100}
    frame = spark.createDataFrame(rows, ROWS).withColumns({"x": F.lit("x"), "norm": F.lit(1), "bucket": F.lit(0), "low": F.lit(0), "embedding2": F.lit(1)})
    assert {tuple(r) for r in N.hard_negatives(frame, F.col("vec_id") % 100 == 0, F.col("label")).collect()} == brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], [(0, [], 1), (1, [], 1), (2, [], 0)], [(0, [1.0], 1), (1, [1.0], 1), (2, [-1.0], 0)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_floating_point(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(0.5, 1) * 3e6 for _ in range(3)], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_query_against_sql(spark, sf_dir):
    compare(queries.op13_hard_negatives(spark, sf_dir), connection(sf_dir), queries.ORACLE["op13_hard_negatives"])
