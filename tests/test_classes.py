"""Components kept under change equal the components of the whole graph."""

from __future__ import annotations

import random

import pytest

from quillmesh.plans.classes import updated_classes
from quillmesh.plans.components import connected_components

EDGES = "a string, b string"


def frames(spark, *edges):
    return [spark.createDataFrame(sorted(e), EDGES) for e in edges]


def nodes_frame(spark, nodes):
    return spark.createDataFrame([(n,) for n in sorted(nodes)], "node string")


def brute(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def step(spark, classes, nodes, edges, nodes_now, edges_now):
    """One change; returns the new table and how many rows were written."""
    table = spark.createDataFrame(sorted(classes.items()), "node string, component string")
    stay, removed, added = frames(spark, edges & edges_now, edges - edges_now, edges_now - edges)
    changed, dropped = updated_classes(table, stay, removed, added, nodes_frame(spark, nodes - nodes_now), nodes_frame(spark, nodes_now - nodes))
    new = dict(map(tuple, changed.collect()))
    assert all(classes.get(n) != c for n, c in new.items())
    out = {n: c for n, c in {**classes, **new}.items() if n not in {r[0] for r in dropped.collect()}}
    return out, len(new)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_history(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(40):02}"
    nodes, edges, classes = set(), set(), {}
    for _ in range(4):
        nodes_now = {n for n in nodes if rng.random() < 0.93} | {name() for _ in range(8)}
        edges_now = {e for e in edges if rng.random() < 0.85 and set(e) <= nodes_now}
        pool = sorted(nodes_now)
        edges_now |= {tuple(rng.sample(pool, 2)) for _ in range(5)}
        classes, _ = step(spark, classes, nodes, edges, nodes_now, edges_now)
        nodes, edges = nodes_now, edges_now
        assert classes == brute(nodes, edges)


def test_what_is_written_is_what_changed(spark):
    """A leaf that leaves a large class, and two classes that join, write their own rows only."""
    star = {("a", f"x{i:03}") for i in range(200)}
    nodes = {n for e in star for n in e} | {"p", "q"}
    edges = star | {("p", "q")}
    classes = brute(nodes, edges)
    now, written = step(spark, classes, nodes, edges, nodes - {"x007"}, edges - {("a", "x007")})
    assert written == 0 and now == brute(nodes - {"x007"}, edges - {("a", "x007")})
    now, written = step(spark, classes, nodes, edges, nodes, edges | {("q", "x001")})
    assert written == 2 and now == brute(nodes, edges | {("q", "x001")})
    now, written = step(spark, classes, nodes, edges, nodes, edges - {("a", "x009")})
    assert written == 1 and now["x009"] == "x009"
    # the node a class is named after goes
    left = {n for n in nodes if n != "a"}
    now, _ = step(spark, classes, nodes, edges, left, {("p", "q")})
    assert now == brute(left, {("p", "q")})


def test_odd_edges(spark):
    table = spark.createDataFrame([], "node string, component string")
    odd = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), (None, "b"), ("c", None)], EDGES)
    none, no_nodes = spark.createDataFrame([], EDGES), nodes_frame(spark, [])
    changed, dropped = updated_classes(table, none, none, odd, no_nodes, nodes_frame(spark, "abc"))
    assert dict(map(tuple, changed.collect())) == {"a": "a", "b": "a", "c": "c"} and dropped.isEmpty()
    same, _ = updated_classes(changed, odd, none, none, no_nodes, no_nodes)
    assert same.isEmpty()
    assert connected_components(none).isEmpty()
