from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import modes as M
from quillmesh.operators import retrieval as R
from quillmesh.operators.planning import Entity, merge_entities, plan_query, rule_terms
from quillmesh.config import Settings


def test_exact_search(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.8, 0.2, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, vector array<float>")
    assert [r.id for r in R.top_inner_product(base, q, 2).orderBy("rank").collect()] == [1, 3]
    assert R.top_inner_product(base.limit(0), q, 2).count() == 0
    new = spark.createDataFrame([(9, [0.0, 0.0, 1.0])], base.schema)
    assert R.add_vectors(base, new).count() == 4
    with pytest.raises(ValueError):
        R.add_vectors(base, base.limit(1))
    assert R.replace_vectors(base, base.filter("vec_id = 1")).count() == 3


def test_many_queries_agree_with_few(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7) for k in range(1, 5)]) for i in range(60)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = base.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    few = {(r.query_id, r.id, r["rank"]) for r in R.top_inner_product(base, asked, 3).collect()}
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 7)
    assert few == {(r.query_id, r.id, r["rank"]) for r in R.top_inner_product(base, asked, 3).collect()}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, score double, content string, family_id string, granularity string")


def test_threshold_and_floor(spark):
    c = chunks(spark, [("chunk-1", 1.0, "vector document", "f1", "small"), ("chunk-2", 0.8, "graph document", "f2", "small")])
    got = R.rag_query(c, "graph", 5, 10, 10, 0.6, rerank=lambda rows, q: rows.withColumn("rerank_score", F.when(F.col("chunk_id") == "chunk-2", 0.04).otherwise(0.02)).withColumn("rerank_rank", F.when(F.col("chunk_id") == "chunk-2", 1).otherwise(2)))
    assert [(r.chunk_id, r.effective) for r in got.collect()] == [("chunk-2", 0.75)]


def test_families(spark):
    c = chunks(spark, [("l", 0.9, "", "l", "large"), ("m", 0.9, "", "l", "medium"), ("s", 0.9, "", "l", "small"), ("o", 0.2, "", "o", "medium")])
    assert [r.chunk_id for r in R.collapse_families(c, 10).collect()] == ["s", "o"]
    assert [r.chunk_id for r in R.collapse_families(c.filter("granularity = 'large'"), 10).collect()] == ["l"]
    tree = spark.createDataFrame([("l", None), ("m", "l"), ("s", "m")], "chunk_id string, parent_chunk_id string")
    assert {r.family_id for r in R.with_family(tree).collect()} == {"l"}


def test_rescue(spark):
    c = chunks(spark, [("a", 0.9, "reading", "a", "small"), ("b", -0.1, "x", "b", "small")])
    asked = [("看书", 1.0), ("阅读", 0.85)]
    got = R.rag_query(c, "看书", 5, 10, 10, None, asked).collect()
    assert [(r.chunk_id, r.low_confidence) for r in got] == [("a", True)]
    assert R.rag_query(c, "看书", 5, 10, 10, 0.6, asked).count() == 0


def test_anchor_factor(spark):
    scores = spark.createDataFrame([("anchor", 0.6), ("plain", 0.9)], "chunk_id string, score double")
    links = spark.createDataFrame([("anchor", "n")], "chunk_id string, node_id string")
    got = {r.chunk_id: r.score for r in M.anchored(scores, links, links, 2.0).collect()}
    assert got == {"anchor": 1.2, "plain": 0.9}
    with pytest.raises(ValueError):
        M.anchored(scores, links, links, 0.5)


def test_plan():
    said = {"rewrites": [{"text": "阅读", "kind": "synonym"}, {"text": "阅读理解", "kind": "related"}, {"text": "看书", "kind": "synonym"}], "entities": [{"text": "阅读", "aliases": ["看书"], "confidence": 0.95}]}
    plan = plan_query(" 看书 ", lambda q: said, Settings(planning_mode="auto"))
    assert [(v.text, v.weight) for v in plan.variants] == [("看书", 1.0), ("阅读", 0.85), ("阅读理解", 0.65)]
    assert plan.entities[0].aliases == ("看书",)

    def broken(q):
        raise OSError

    failed = plan_query("x", broken, Settings(planning_mode="auto"))
    assert failed.degraded and len(failed.variants) == 1
    assert len(plan_query("x", lambda q: said).variants) == 1


def test_entities(spark):
    two = merge_entities([Entity("KG", "knowledge graph", ("KG",), 0.7), Entity("kg", "Knowledge Graph", ("knowledge graph",), 0.95)])
    assert len(two) == 1 and two[0].confidence == 0.95 and two[0].aliases == ("KG", "knowledge graph")
    df = spark.createDataFrame([("知识图谱和向量检索的关系",), ("knowledge graph vs RAG",), ('"quoted part" and 布',)], "t string")
    got = [r[0] for r in df.select(rule_terms(df.t)).collect()]
    assert got[0] == ["知识图谱", "向量检索"] and got[1] == ["knowledge graph", "RAG"] and got[2][0] == "quoted part"


def test_federated(spark):
    def lost():
        raise OSError("gone")

    one = spark.createDataFrame([(1, 0.8)], "id long, score double")
    found, failed = M.federated({"a": lambda: one, "b": lost}, "id")
    assert [(r.store, r.federated_score) for r in found.collect()] == [("a", 0.8)] and list(failed) == ["b"]


def test_answer(spark):
    empty = spark.createDataFrame([], "section string, position long, body string")
    assert M.answer(empty, "q") == M.NOT_FOUND
    full = spark.createDataFrame([("passages", 0, "fact")], empty.schema)
    assert M.answer(full, "q") == "fact"
    assert M.answer(full, "q", lambda q, c: f"{q}:{len(c)}") == "q:1"


def test_families_of_any_depth(spark):
    tree = lambda rows: spark.createDataFrame(rows, "chunk_id string, parent_chunk_id string")
    chain = [("c0", None), *[(f"c{i}", f"c{i - 1}") for i in range(1, 9)], ("x", None)]
    assert {r.chunk_id: r.family_id for r in R.with_family(tree(chain)).collect()} == {**{f"c{i}": "c0" for i in range(9)}, "x": "x"}
    for rows, why in (([("a", "b")], "missing"), ([("a", "b"), ("b", "a")], "cycle"), ([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "cycle"), ([("a", "a")], None)):
        if why:
            with pytest.raises(ValueError, match=why):
                R.with_family(tree(rows)).collect()


def test_the_parents_text_is_read(spark):
    chunks = spark.createDataFrame([("m", None, "medium", "all about graphs"), ("s", "m", "small", "about")], "chunk_id string, parent_chunk_id string, granularity string, content string")
    found = R.with_context(chunks.withColumn("score", F.lit(0.5)), chunks)
    got = {r.chunk_id: r for r in R.overlap_rerank(found, "graphs").collect()}
    assert got["s"].rerank_score == got["m"].rerank_score == 1 and got["s"].context.content == "all about graphs" and got["m"].context is None


def test_rankings_of_models_are_checked(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    ranked = lambda *rows: spark.createDataFrame(rows, "chunk_id string, rerank_score double, rerank_rank int")
    assert R.checked(ranked(("b", 0.5, 1)), asked).count() == 1
    for rows in ([("a", 0.5, 1), ("a", 0.4, 2)], [("a", float("nan"), 1)], [("c", 0.5, 1)], [("a", 0.5, 1), ("b", 0.5, 1)], [("a", None, 1)]):
        with pytest.raises(ValueError):
            R.checked(ranked(*rows), asked)


def test_a_store_that_fails_late_fails_alone(spark):
    from quillmesh.operators.modes import federated

    good = spark.createDataFrame([("x", 0.5)], "chunk_id string, score double")
    found, failed = federated({"good": lambda: good, "late": lambda: good.withColumn("score", F.expr("raise_error('lost')").cast("double"))}, "chunk_id")
    assert [r.store for r in found.collect()] == ["good"] and set(failed) == {"late"}
