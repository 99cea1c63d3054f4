"""Depth of components against distances between all nodes."""

from __future__ import annotations

import random
from collections import deque

import pytest

from quillmesh.operators import organise as O


def depths(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in nodes:
        away, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for to in near[at]:
                if to not in away:
                    away[to] = away[at] + 1
                    queue.append(to)
        root = min(away)
        out[root] = (len(away), max(out.get(root, (0, 0))[1], *away.values()))
    return out


@pytest.mark.parametrize("looks", [0, 1, 3])
def test_against_all_distances(spark, looks):
    rng = random.Random(looks)
    edges = set()
    for c in range(40):  # small components of all shapes
        names = [f"c{c:02}{i}" for i in range(rng.randrange(2, 8))]
        edges |= {(a, rng.choice(names[: i + 1])) for i, a in enumerate(names[1:])}
        edges |= {tuple(rng.sample(names, 2)) for _ in range(rng.randrange(6))}
    edges |= {(f"p{i}", f"p{(i + 1) % 5}") for i in range(5)}  # a ring of five: two hops, and no node next to all
    edges |= {("s", "s"), ("hub", "l0")} | {("hub", f"l{i}") for i in range(60)} | {("l1", "l2")}
    # two hubs side by side: three hops from leaf to leaf of different ones
    edges |= {("x", f"x{i}") for i in range(30)} | {("y", f"y{i}") for i in range(30)} | {("x", "y")}
    # every leaf tied to both of two hubs, which aren't tied: two hops
    edges |= {(h, f"z{i}") for h in ("za", "zb") for i in range(30)}
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    n = spark.createDataFrame([(x,) for x in nodes], "node_id string")
    e = spark.createDataFrame(sorted(edges), "source_node_id string, target_node_id string")
    got = {r.component: r.node_count for r in O.qualified(O.components(n, e), e, looks).collect()}
    assert got == {root: size for root, (size, depth) in depths(nodes, edges).items() if size >= 3 and depth >= 3}
    assert "x" in got and "hub" not in got and "za" not in got and "p0" not in got
