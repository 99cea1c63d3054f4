from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import evidence as E
from quillmesh.operators import graph as G
from quillmesh.operators import organise as O
from quillmesh.operators.planning import Entity, entity_frame
from quillmesh.plans.components import connected_components

NODES = [("node-kg", "知识图谱", ["KG"]), ("node-vector", "向量检索", []), ("node-embedding", "Embedding", ["嵌入"]), ("node-structure", "数据结构", [])]
EDGES = [
    ("edge-complement", "node-kg", "互补", "node-vector", 0.9, 2),
    ("edge-uses", "node-vector", "使用", "node-embedding", 0.8, 1),
    ("edge-supports", "node-structure", "支持", "node-kg", 0.7, 1),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, keyword string, aliases array<string>")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "edge_id string, source_node_id string, relation string, target_node_id string, weight double, support_count long")


def hits(spark, nodes, text, threshold=0.6, confidence=1.0):
    found = G.match_nodes(entity_frame(spark, [Entity(text, text, (), confidence)]), nodes, threshold)
    return {r.node_id: r.score for r in found.collect()}


def test_matching(spark, nodes):
    assert hits(spark, nodes, "KG") == {"node-kg": 0.9}
    assert hits(spark, nodes, "知识图普", 0.7) == {"node-kg": 0.75}
    canvas = spark.createDataFrame([("a", "中央画布", []), ("b", "SVG画布", []), ("c", "布", [])], nodes.schema)
    found = hits(spark, canvas, "画布", 0.7, 0.95)
    assert set(found) == {"a", "b"} and min(found.values()) > 0.7
    assert hits(spark, canvas.filter("node_id != 'c'"), "布") == {}


def test_expansion_and_paths(spark, nodes, edges):
    start = spark.createDataFrame([("node-kg", 1)], "node_id string, ord long")
    visited, touched = G.expand(edges, start, 2)
    assert {(r.node_id, r.depth, r.direction) for r in visited.collect()} == {
        ("node-kg", 0, None), ("node-vector", 1, "forward"), ("node-structure", 1, "backward"), ("node-embedding", 2, "forward"),
    }
    assert touched.count() == 3
    found = G.paths(visited, edges, nodes).collect()
    assert [(r.path, r.weight) for r in found] == [("知识图谱->[互补]->向量检索->[使用]->Embedding", 0.8)]
    only, _ = G.expand(edges, start, 1, "forward")
    assert {r.node_id for r in only.collect()} == {"node-kg", "node-vector"}
    none, edge = G.expand(edges, start, 0)
    assert none.count() == 1 and edge.count() == 0
    with pytest.raises(ValueError):
        G.expand(edges, start, 11)


def test_backward_paths_read_forward(spark, nodes, edges):
    start = spark.createDataFrame([("node-embedding", 1)], "node_id string, ord long")
    visited, _ = G.expand(edges, start, 2, "backward")
    assert G.paths(visited, edges, nodes).first().path == "知识图谱->[互补]->向量检索->[使用]->Embedding"


def test_neighbourhood(spark):
    edges = spark.createDataFrame([("e1", "a", "r", "b"), ("e2", "b", "r", "c"), ("e3", "d", "r", "b")], "edge_id string, source_node_id string, relation string, target_node_id string")
    run = lambda **k: G.neighbourhood(edges, "b", k.pop("depth", 1), **k)
    assert {r.node_id for r in run(direction="forward")[0].collect()} == {"b", "c"}
    assert {r.node_id for r in run(direction="backward")[0].collect()} == {"a", "b", "d"}
    assert {(r.node_id, r.depth) for r in run(depth=2)[0].collect()} == {("b", 0), ("a", 1), ("c", 1), ("d", 1)}
    nodes, _, cut, _ = run(node_limit=2)
    assert cut and nodes.count() == 2
    assert run(depth=2, edge_limit=1)[3]
    with pytest.raises(ValueError):
        run(depth=11)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    tangled = [(i, (i * 37 + 11) % 211) for i in range(0, 211, 2)] + [(i, i + 1) for i in range(300, 331)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in tangled:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(tangled, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_qualified(spark):
    star = [("s0", f"s{i}") for i in range(1, 6)]
    path = [(f"p{i}", f"p{i + 1}") for i in range(3)]
    edges = spark.createDataFrame([*star, *path], "source_node_id string, target_node_id string")
    nodes = spark.createDataFrame([(x,) for e in [*star, *path] for x in e], "node_id string").distinct()
    found = O.qualified(O.components(nodes, edges), edges).collect()
    assert [(r.component, r.node_count) for r in found] == [("p0", 4)]


def test_merge(spark):
    raw = spark.createDataFrame(
        [("n1", "r", "n3", "s1", 0.6), ("n2", "r", "n3", "s2", 0.9)], "source_node_id string, relation string, target_node_id string, source_id string, evidence_weight double"
    )
    weights = E.node_aggregate(E.node_bindings(raw))
    names = spark.createDataFrame([("n1", "Alpha", "x", ["A"], []), ("n2", "A", "yy", [], ["t"]), ("n3", "Beta", "", [], [])], "node_id string, keyword string, summary string, aliases array<string>, tags array<string>")
    nodes = names.join(weights, "node_id")
    moves = O.redirects(O.exact_merges(names), nodes)
    assert {(r.node_id, r.keep_id) for r in moves.collect()} == {("n1", "n2"), ("n2", "n2")}
    edge = E.edge_aggregate(O.rewire(raw, moves)).collect()
    assert [(e.source_node_id, e.weight, e.support_count) for e in edge] == [("n2", 0.9, 2)]
    merged = {r.node_id: r for r in O.merge_names(names, moves).collect()}
    assert set(merged) == {"n2", "n3"} and merged["n2"].aliases == ["Alpha"] and merged["n2"].summary == "yy"


def test_resolution_needs_one_node(spark):
    nodes = spark.createDataFrame([("a", "Alpha", ["x"]), ("b", "Beta", ["x"])], "node_id string, keyword string, aliases array<string>")
    said = spark.createDataFrame([(1, "alpha", []), (2, "X", []), (3, "new", [])], "mention_id long, keyword string, aliases array<string>")
    from quillmesh.functions.text import norm_key

    got = {r.mention_id: r.node_id for r in E.resolve_mentions(said, nodes, norm_key).collect()}
    assert got[1] == "a" and got[2].startswith("new:") and got[3].startswith("new:")


def test_ratio_never_exceeds_its_bound(spark):
    import random
    from difflib import SequenceMatcher

    from quillmesh.functions.text import difflib_ratio, ratio_bound

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(12)))
    rows = [(word(), word()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", ratio_bound(df.a, df.b).alias("most"), difflib_ratio("a", "b").alias("ratio")).collect():
        assert r.ratio == SequenceMatcher(None, r.a, r.b).ratio() <= r.most + 1e-9


@pytest.mark.parametrize("few", [0, 100])
def test_distances_are_those_of_expansion_and_write_no_edges(spark, edges, few, monkeypatch):
    monkeypatch.setattr(E, "FEW_NODES", few)
    start = spark.createDataFrame([("node-kg", 1)], "node_id string, ord long")
    twice = edges.unionByName(edges)
    for direction in G.DIRECTIONS:
        want = {(r.node_id, r.depth) for r in G.expand(edges, start, 3, direction)[0].collect()}
        got = G.distances(twice, start, 3, direction).collect()
        assert {(r.node_id, r.depth) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        G.distances(edges, start, 11)


@pytest.mark.parametrize("name", ["bfs_distance", "hybrid_query"])
def test_queries_of_distances_write_no_edges(spark, sf_dir, name, monkeypatch):
    from quillmesh import catalog

    written, keep = [], G.durable
    monkeypatch.setattr(G, "durable", lambda df: written.append(df.columns) or keep(df))
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
    assert written and not any("edge_id" in columns for columns in written)


@pytest.mark.parametrize("few", [0, 100])
def test_tasks_of_redirected_edges_follow_the_rows(spark, few, monkeypatch):
    monkeypatch.setattr(O, "FEW_NODES", few)
    monkeypatch.setattr(E, "TASK_ROWS", 10)
    raw = [(f"s{i % 7}", "r", f"t{i % 3}", i % 5, i / 100) for i in range(100)] + [("s1", "r", "s0", 9, 0.5), ("s2", None, "t1", 9, 0.5)]
    frame = spark.createDataFrame(raw, "source_node_id string, relation string, target_node_id string, source_id long, evidence_weight double")
    moves = spark.createDataFrame([("s1", "s0"), ("s3", "s2"), ("t2", "t0")], "node_id string, keep_id string")
    to, want = {"s1": "s0", "s3": "s2", "t2": "t0"}, {}
    for s, r, t, source, w in raw:
        s, t = to.get(s, s), to.get(t, t)
        if s != t:
            want.setdefault((s, r, t), []).append((source, w))
    found = E.edge_aggregate(O.redirected(frame, moves, len(raw)), len(raw))
    assert {(r.source_node_id, r.relation, r.target_node_id): (r.weight, r.support_count) for r in found.collect()} == {
        k: (max(w for _, w in v), len({s for s, _ in v})) for k, v in want.items()
    }
    assert found.rdd.getNumPartitions() == 11
    names = E.edge_names(frame, len(raw))
    assert {r.edge_id for r in names.collect()} == {r.edge_id for r in E.edge_aggregate(frame).collect()} and names.count() == E.edge_aggregate(frame).count()


@pytest.mark.parametrize("few", [0, 100])
def test_neighbours_of_pairs_told_twice(spark, few, monkeypatch):
    """Evidence told twice counts once, pairs asked twice count alike, keys of relations aren't made edge by edge."""
    monkeypatch.setattr(E, "FEW_NODES", few)
    nodes = spark.createDataFrame([(x, x.upper()) for x in "abcde"], "node_id string, keyword string")
    rows = [("a", "R", "c"), ("a", "R", "c"), ("b", "r", "c"), ("b", "r", "d"), ("e", None, "a"), ("e", None, "b")]
    edges = spark.createDataFrame(rows, "source_node_id string, relation string, target_node_id string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "z")], "a string, b string")
    every = O.neighbour_signatures(edges, nodes)
    assert {(r.node_id, r.signature) for r in every.collect()} == {
        ("a", "out:r:c"), ("b", "out:r:c"), ("b", "out:r:d"), ("c", "in:r:a"), ("c", "in:r:b"), ("d", "in:r:b"), ("a", "in:e"), ("b", "in:e"), ("e", "out:a"), ("e", "out:b"),
    }
    assert every.count() == 10
    some = O.neighbour_signatures(edges, nodes, of=pairs.select(F.col("a").alias("node_id")).unionByName(pairs.select(F.col("b").alias("node_id"))))
    assert {r.node_id for r in some.collect()} == {"a", "b"}
    got = sorted((r.a, r.b, round(r.jaccard, 6)) for r in O.neighbour_jaccard(pairs, some).collect())
    assert got == [("a", "a", 1.0), ("a", "b", 0.666667), ("a", "b", 0.666667), ("a", "z", 0.0)]
