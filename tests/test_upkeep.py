from __future__ import annotations

import datetime as dt

import pytest

from quillmesh.config import DEFAULTS, SHIPPED
from quillmesh.operators import upkeep as U
from quillmesh.sources import files as Fs
from quillmesh.sources import models as M

SOURCES = "source_id string, content_hash string, graph_hash string, rag_hash string, graph_status string, rag_status string, exists_status string"


@pytest.fixture
def tables(spark):
    edges = spark.createDataFrame([("a", "r", "b", "s1", 0.9), ("a", "r", "b", "s2", 0.5), ("b", "r", "c", "s2", 0.4)], "source_node_id string, relation string, target_node_id string, source_id string, evidence_weight double")
    nodes = spark.createDataFrame([("a", "s1", 0.9), ("b", "s1", 0.9), ("a", "s2", 0.5), ("b", "s2", 0.5), ("c", "s2", 0.4), ("c", "s3", 0.1)], "node_id string, source_id string, evidence_weight double")
    chunks = spark.createDataFrame([("k1", "s1"), ("k2", "s2"), ("k3", "s3")], "chunk_id string, source_id string")
    return edges, nodes, chunks


def test_document_cascade(spark, tables):
    left = U.delete_documents(*tables, spark.createDataFrame([("s1",)], "source_id string"))
    assert {(r.edge_id, r.weight, r.support_count) for r in left["edges"].collect()} == {("a|r|b", 0.5, 1), ("b|r|c", 0.4, 1)}
    assert left["chunks"].count() == 2
    none = U.delete_documents(*tables, spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source_id string"))
    assert not any(none[k].count() for k in none)


def test_node_and_relation_cascade(tables):
    left = U.delete_node(*tables, "c")
    assert {r.edge_id for r in left["edges"].collect()} == {"a|r|b"}
    assert {r.source_id for r in left["deleted_sources"].collect()} == {"s3"}
    assert {r.chunk_id for r in left["chunks"].collect()} == {"k1", "k2"}
    assert {r.edge_id for r in U.delete_relation(tables[0], "a|r|b")["edges"].collect()} == {"b|r|c"}


def test_batch_delete():
    def delete(x):
        if x == "b":
            raise KeyError(x)

    got = U.batch_delete(["a", "b", "a"], delete)
    assert got["deleted"] == ["a"] and [f["id"] for f in got["failed"]] == ["b"]
    with pytest.raises(ValueError):
        U.batch_delete([], delete)


def test_states(spark):
    s = spark.createDataFrame([("a", "1", None, "1", "pending", "ready", "active"), ("b", "2", "1", None, "failed", "pending", "active"), ("c", "1", None, None, "pending", "pending", "deleted")], SOURCES)
    assert {r.source_id for r in U.pending(s, "graph").collect()} == {"a"}
    assert {r.source_id for r in U.pending(s, "graph", True).collect()} == {"a", "b"}
    assert {r.source_id for r in U.pending(s, "both").collect()} == {"a", "b"}
    done = spark.createDataFrame([("a", "1", None), ("b", "1", None), ("c", "1", "x")], "source_id string, used_hash string, error string")
    got = {r.source_id: (r.graph_status, r.graph_hash) for r in U.settle(s, "graph", done).collect()}
    assert got == {"a": ("ready", "1"), "b": ("pending", "1"), "c": ("failed", None)}
    edited = U.edit_content(s, "a", "1", "new").filter("source_id = 'a'").first()
    assert edited.rag_status == "pending" and edited.content_hash != "1"
    with pytest.raises(ValueError):
        U.edit_content(s, "a", "0", "new")
    drift = U.after_drift(s, U.chunking_signature(DEFAULTS), SHIPPED, True)
    assert {r.source_id: r.rag_status for r in drift.collect()} == {"a": "pending", "b": "pending", "c": "pending"}
    assert U.after_drift(s, U.chunking_signature(SHIPPED), SHIPPED, True) is s
    now = dt.datetime(2024, 1, 1)
    kept = U.recycle(s, s.filter("source_id = 'c'"), now, 7)
    from pyspark.sql import functions as F

    from quillmesh.operators.changes import expired

    assert expired(kept, F.lit(now)).count() == 0 and expired(kept, F.lit(now), True).count() == 1 and expired(kept, F.lit(now + dt.timedelta(8))).count() == 1


def test_jobs():
    q = U.JobQueue([U.Job("old", "x", "running")], keep=2)
    assert q.jobs["old"].status == "failed"

    def work(job):
        job.advance(0.5, "half")
        job.advance(0.2)
        assert job.progress == 0.5
        with pytest.raises(RuntimeError):
            q.run("inner", "x", lambda j: 1)
        return 7

    assert q.run("a", "x", work).result == 7 and q.jobs["a"].progress == 1.0
    assert q.run("b", "x", lambda j: 1 / 0).status == "failed"
    assert set(q.jobs) == {"a", "b"}
    assert U.due(dt.datetime(2024, 1, 2, 3, 5), "03:00", dt.date(2024, 1, 1)) and not U.due(dt.datetime(2024, 1, 2, 3, 5), "03:00", dt.date(2024, 1, 2))


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "b.MD").write_text("B")
    (tmp_path / "d" / "a.md").write_text("# A")
    (tmp_path / "x.bin").write_text("x")
    got = Fs.scan_directory(spark, str(tmp_path)).collect()
    assert [(r.relative_path, r.text) for r in got] == [("b.MD", "B"), ("d/a.md", "# A")]
    with pytest.raises(ValueError):
        Fs.scan_directory(spark, str(tmp_path), most=1)
    (tmp_path / "B.md").write_text("clash")
    with pytest.raises(ValueError):
        Fs.scan_directory(spark, str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in Fs.import_files(spark, [str(tmp_path / "x.bin"), str(tmp_path / "b.MD")]).collect()}
    assert errors["x.bin"] == "refused: kind .bin" and errors["b.MD"] is None
    one = spark.createDataFrame([("a.md", "x")], "relative_path string, text string")
    assert Fs.upload(one, one.selectExpr("'b.md' relative_path", "text")).count() == 2
    with pytest.raises(ValueError):
        Fs.upload(one, one)
    assert Fs.path_identity("/Dir\\A.md/") == "dir/a.md"


def test_log(spark, tmp_path):
    lines = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "info", "Authorization: Bearer abc.def\tapi_key=zzz"), (dt.datetime(2024, 1, 2), "debug", "x")], "ts timestamp, level string, message string")
    Fs.write_log(lines, str(tmp_path / "log"))
    got = spark.read.option("sep", "\t").csv(str(tmp_path / "log")).collect()
    assert len(got) == 1 and "abc" not in got[0][2] and "zzz" not in got[0][2]


def test_models(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b c",)], "t string")
    assert all(len(r.vector) == 64 for r in M.embed(rows, "t", M.HashEmbedder(), 64).collect())
    for wrong in (lambda t: [], lambda t: [[1.0]] * len(t), lambda t: [[float("nan")] * 64] * len(t)):
        with pytest.raises(Exception):
            M.checked(["a", "b"], wrong(["a", "b"]), 64)
    assert M.fenced_json('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    c = spark.createDataFrame([("x", 0.1, "t1"), ("y", 0.9, "t2")], "chunk_id string, score double, content string")
    got = {r.chunk_id: r.rerank_rank for r in M.rerank_rows(c, "q", lambda q, ts: [(0, 0.2), (1, 0.7)], 5).collect()}
    assert got == {"y": 2, "x": 1}
    with pytest.raises(ValueError):
        M.rerank_rows(c, "q", lambda q, ts: [(0, 1.0), (0, 1.0)], 5)
