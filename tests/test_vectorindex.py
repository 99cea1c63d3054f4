"""The exact index of vectors against a plain scan: ties, changes, hot groups, odd rows, skipped blocks."""

from __future__ import annotations

import numpy as np
import pytest

from quillmesh.operators import vectorindex
from quillmesh.operators.vectorindex import VectorIndex

SCHEMA, ASKS = "id long, vector array<float>", "query_id long, vector array<double>"
SIZE = 8


def rows_of(x, first=0):
    return [(first + i, [float(c) for c in row]) for i, row in enumerate(np.asarray(x, "f4"))]


def clustered(n, seed=0, groups=40):
    """Vectors close to a few directions, as embeddings of texts on a few subjects are."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, SIZE)) * 4
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, SIZE)) * 0.05


def plain(rows, asks, k):
    """Sums component by component in double precision, ties to smaller ids."""
    out = set()
    for query, q in asks:
        scored = [(-float(np.cumsum(np.array(q, "f8") * np.array(v, "f8"))[-1]), i) for i, v in rows]
        out |= {(query, i, n) for n, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def got(found):
    return {(r.query_id, r.id, r["rank"]) for r in found.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectorindex, "BLOCKS_A_TASK", 8)
    monkeypatch.setattr(vectorindex, "BOUND_VALUES", 32 * SIZE)
    monkeypatch.setattr(vectorindex, "GROUP", 5)


def test_search_equals_a_scan_and_skips_blocks(spark, tmp_path, small_blocks):
    x = clustered(2000)
    x[500:900] = x[500]  # copies, more than a block holds
    rows, asks = rows_of(x), [(i, [float(c) for c in x[i]]) for i in (0, 3, 500, 501, 1200, 1999)]
    index = VectorIndex(spark, str(tmp_path / "i"), SIZE)
    assert index.build(spark.createDataFrame(rows, SCHEMA)) > 2000 // 16
    queries = spark.createDataFrame(asks, ASKS)
    assert got(index.search(queries, 7)) == plain(rows, asks, 7)
    assert index.blocks_read(queries, 7) < 0.5
    assert max(r.rows for r in index.read("bounds").collect()) <= 16


def test_vectors_without_structure_are_found_too(spark, tmp_path, small_blocks):
    x = np.random.default_rng(5).normal(size=(600, SIZE))
    rows, asks = rows_of(x), rows_of(x[::50], 1000)
    index = VectorIndex(spark, str(tmp_path / "i"), SIZE)
    index.build(spark.createDataFrame(rows, SCHEMA))
    assert got(index.search(spark.createDataFrame(asks, ASKS), 10)) == plain(rows, asks, 10)
    # more asked for than there is
    assert got(index.search(spark.createDataFrame(asks[:2], ASKS), 700)) == plain(rows, asks[:2], 700)


def test_changes_equal_a_fresh_index_and_write_little(spark, tmp_path, small_blocks):
    x = clustered(1500, 1)
    held = dict(rows_of(x))
    index = VectorIndex(spark, str(tmp_path / "i"), SIZE)
    index.build(spark.createDataFrame([*held.items()], SCHEMA))
    whole = index.bytes_held()
    new = rows_of(clustered(10, 2), 5000)
    assert index.bytes_written(index.add(spark.createDataFrame(new, SCHEMA))) < whole / 4
    held |= dict(new)
    gone = [7, 8, 9, 5001, 77_777]
    assert index.bytes_written(index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))) < whole / 4
    for i in gone:
        held.pop(i, None)
    moved = [(20, [float(c) for c in x[0] * 3]), (7, [1.0] * SIZE)]
    index.replace(spark.createDataFrame(moved, SCHEMA))
    held |= dict(moved)
    asks = rows_of(x[::300], 0)
    assert got(index.search(spark.createDataFrame(asks, ASKS), 5)) == plain(held.items(), asks, 5)
    assert {r.id for r in index.ids().collect()} == set(held)
    places = {(r.id, r.block) for r in index.read("places").collect()}
    assert places == {(str(i), r.block) for r in index.read("blocks").collect() for i in r.ids}
    assert {r.block for r in index.read("bounds").collect()} == {b for _, b in places}
    with pytest.raises(ValueError, match="taken"):
        index.add(spark.createDataFrame(new[:1], SCHEMA))
    with pytest.raises(ValueError, match="repeat"):
        index.add(spark.createDataFrame([(9000, new[0][1]), (9000, new[1][1])], SCHEMA))


def test_odd_rows_take_no_part(spark, tmp_path):
    good = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])]
    odd = [(4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [9.0, 9.0]), (9, [])]
    index = VectorIndex(spark, str(tmp_path / "i"), 2)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (None, [1.0, 0.0])], ASKS)
    assert index.build(spark.createDataFrame([], SCHEMA)) == 0
    assert index.search(queries, 3).count() == 0 and index.blocks_read(queries, 3) == 0
    index.build(spark.createDataFrame(good + odd, SCHEMA))
    assert got(index.search(queries, 3)) == {(0, 1, 1), (0, 2, 2), (0, 3, 3)}
    assert index.search(queries.limit(0), 3).count() == 0
    index.replace(spark.createDataFrame([(1, None)], SCHEMA))
    assert got(index.search(queries, 3)) == {(0, 2, 1), (0, 3, 2)}
    index.delete(spark.createDataFrame([(2,), (3,)], "id long"))
    assert index.search(queries, 3).count() == 0


def test_ids_may_be_strings_and_another_session_reads_the_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), 2, "string", "double")
    index.build(spark.createDataFrame([("b", [1.0, 1.0]), ("a", [1.0, 1.0]), ("c", [2.0, 0.0])], "id string, vector array<double>"))
    again = VectorIndex(spark.newSession(), str(tmp_path / "i"), 2, "string", "double")
    queries = again.spark.createDataFrame([(0, [1.0, 1.0])], ASKS)
    assert [(r.id, r.score) for r in again.search(queries, 2).orderBy("rank").collect()] == [("a", 2.0), ("b", 2.0)]
