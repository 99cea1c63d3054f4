from __future__ import annotations

import datetime as dt

import pytest

from quillmesh.operators import changes as C
from quillmesh.operators import listing as L
from quillmesh.streaming.sync import SnapshotState, fold_batch, stream_sync

BATCH = "source_uri string, revision string, updated_at timestamp, content string, metadata string, deleted boolean"


def at(day):
    return dt.datetime(2024, 1, day)


def test_one_source_through_its_life(spark):
    state = spark.createDataFrame([], C.STATE)
    steps = [
        (("u", "1", at(1), "a", "{}", False), "created"),
        (("u", "1", at(1), "a\r\n", "{}", False), "unchanged"),
        (("u", "2", at(2), "a", "{x}", False), "metadata_updated"),
        (("u", "1", at(1), "b", "{}", False), "stale"),
        (("u", "2", at(2), "b", "{x}", False), "conflict"),
        (("u", "3", at(3), "b", "{x}", False), "updated"),
        (("u", "3", at(3), None, "{x}", True), "deleted"),
        (("u", "3", at(3), "b", "{x}", False), "updated"),
    ]
    for record, outcome in steps:
        state, told = C.synchronise(state, spark.createDataFrame([record], BATCH))
        state = spark.createDataFrame(state.collect(), C.STATE)
        assert [r.outcome for r in told.collect()] == [outcome]
    assert [r.exists_status for r in state.collect()] == ["active"]
    with pytest.raises(ValueError):
        C.synchronise(state, spark.createDataFrame([steps[0][0]] * 2, BATCH))
    _, told = C.synchronise(state, spark.createDataFrame([("v", "1", at(1), None, None, True)], BATCH))
    assert told.first().outcome == "unchanged"


def test_scan(spark):
    known = spark.createDataFrame([("a", "1", "active"), ("b", "1", "active"), ("c", "1", "deleted"), ("d", "1", "active"), ("e", "1", "deleted")], "path_hash string, content_hash string, exists_status string")
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("n", "1")], "path_hash string, content_hash string")
    got = {r.path_hash: r.change for r in C.scan_difference(known, found).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "restored", "d": "deleted", "n": "new"}


def test_stream_and_replay(spark, tmp_path):
    rows = [("u", str(i), at(i + 1), f"t{i}", "{}", False) for i in range(4)] + [("v", "1", at(9), "x", "{}", False)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_sync(stream, str(tmp_path / "state"), str(tmp_path / "log")).awaitTermination()
    state = SnapshotState(spark, str(tmp_path / "state"))
    want = {("u", "3"), ("v", "1")}
    assert {(r.source_uri, r.revision) for r in state.read().collect()} == want
    last = state.last_batch()
    fold_batch(state, spark.createDataFrame([("w", "1", at(1), "x", "{}", False)], BATCH), last)  # played again
    assert {(r.source_uri, r.revision) for r in state.read().collect()} == want


def test_a_batch_writes_its_keys(spark, tmp_path):
    state = SnapshotState(spark, str(tmp_path / "state"))
    record = "concat('u', lpad(id, 6, '0')) source_uri, '1' revision, timestamp'2024-01-01' updated_at, concat('t', id) content, '{}' metadata, false deleted"
    fold_batch(state, spark.sql(f"SELECT {record} FROM range(20000)"), 0)
    whole = state.bytes_held()
    want = {r.source_uri: (r.revision, r.exists_status) for r in state.read().collect()}
    for number in (1, 2, 3):
        rows = [(f"u{i:06}", str(number + 1), at(number + 1), f"new {number}", "{}", i % 2 == 0) for i in range(number * 7, number * 7 + 5)] + [(f"new{number}", "1", at(1), "x", "{}", False)]
        fold_batch(state, spark.createDataFrame(rows, BATCH), number)
        assert state.bytes_written(state.version()) < 0.05 * whole
        want |= {u: (r, "deleted" if gone else "active") for u, r, _, _, _, gone in rows}
    assert {r.source_uri: (r.revision, r.exists_status) for r in state.read().collect()} == want
    fold_batch(state, spark.createDataFrame([], BATCH), 4)
    assert state.last_batch() == 4 and state.read().count() == len(want)


def test_prune_and_pages(spark):
    rows = [(f"k{i}", 10, None, None, dt.datetime(2024, 1, 1 + i // 3, i)) for i in range(10)]
    entries = spark.createDataFrame(rows, "cache_key string, result_size long, last_hit_at timestamp, updated_at timestamp, created_at timestamp")
    assert {r[0] for r in L.prune_lru(entries, 7, 10**6).collect()} == {"k0", "k1", "k2"}
    assert {r[0] for r in L.prune_lru(entries, 100, 55).collect()} == {f"k{i}" for i in range(5)}
    assert L.prune_lru(entries, 100, 1000).count() == 0
    page, total, pages = L.page(entries, ["cache_key"], 4, 3)
    assert (total, pages, page.count()) == (10, 4, 1)
    with pytest.raises(ValueError):
        L.page(entries, ["cache_key"], 0, 3)


def test_revision_sees_rows_not_order(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    b = spark.createDataFrame([(2, "b"), (1, "a")], "id long, x string").repartition(3)
    c = spark.createDataFrame([(1, "a"), (2, "c")], "id long, x string")
    assert L.revision([("t", a)]) == L.revision([("t", b)]) != L.revision([("t", c)])


def test_integrity_and_map(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "1")], "source_id string, content_hash string")
    bound = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], s.schema)
    assert {tuple(r) for r in C.integrity_violations(s, bound).collect()} == {("b", "hash_mismatch"), ("c", "missing_source")}
    m = spark.createDataFrame([("a", "x"), ("b", "y")], "original string, markdown string")
    new = spark.createDataFrame([("a", "y")], m.schema)
    assert [tuple(r) for r in C.file_map_upsert(m, new).collect()] == [("a", "y")]
