"""Matches by the index of grams against a scan of all nodes in plain Python."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from quillmesh.functions.text import key_of
from quillmesh.operators import graph as G
from quillmesh.operators import textindex as T

NODES = "node_id string, keyword string, aliases array<string>"
ASKED = "entity_idx long, text string, normalized string, aliases array<string>, confidence double"


def scan(asked, nodes, threshold, fuzzy):
    best = {}
    for _, text, normalized, aliases, confidence in asked:
        primary, alternates = key_of(normalized), [t for t in map(key_of, [text, *aliases]) if t]
        for node, keyword, others in nodes:
            name, others = key_of(keyword), [t for t in map(key_of, others or []) if t]
            every = [(a, h) for a in {primary, *alternates} for h in {name, *others}]
            if primary == name:
                score = 1.0
            elif primary in others or name in alternates or set(others) & set(alternates):
                score = 0.9
            elif any(min(len(a), len(h)) >= 2 and (a in h or h in a) for a, h in every):
                score = 0.85
            else:
                score = max(SequenceMatcher(None, a, h).ratio() for a, h in every) if fuzzy else -1.0
            best[node] = max(best.get(node, -1.0), round(score * confidence, 9))
    return {n: s for n, s in best.items() if s >= threshold - 1e-9}


@pytest.mark.parametrize("threshold,fuzzy", [(0.8, True), (0.6, False), (0.3, True)])
def test_against_a_scan(spark, threshold, fuzzy, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé 中") for _ in range(rng.randrange(1, 9))).strip() or "q"
    nodes = [(f"n{i:02}", word().upper() if i % 5 == 0 else word(), [word() for _ in range(rng.randrange(3))] if i % 4 else None) for i in range(70)]
    asked = [(i, word(), word(), [word()] * (i % 2), rng.choice([1.0, 0.9, 0.85])) for i in range(5)]
    asked += [(5, nodes[7][1], nodes[7][1], [], 1.0), (6, "zzz", nodes[9][1], [nodes[11][1]], 0.95)]
    said, held = spark.createDataFrame(asked, ASKED), spark.createDataFrame(nodes, NODES)
    want = scan(asked, nodes, threshold, fuzzy)
    found = lambda rows: {r.node_id: round(r.score, 9) for r in rows.collect()}
    assert found(G.match_nodes(said, held, threshold, fuzzy)) == want
    if threshold == 0.8:
        T.save(held, str(tmp_path / "index"))
        kept = T.match_indexed(said, *T.load(spark, str(tmp_path / "index")), threshold)
        assert found(kept) == want
        plan = kept._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams_are_complete():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
    for _ in range(4000):
        a, b, need = word(), word(), rng.choice([0.5, 0.7, 0.9, 1.0])
        if SequenceMatcher(None, a, b).ratio() >= need:
            grams = T.resembling_grams(a, need, {g: rng.randrange(5) for g in (*a, *T._pairs(a))})
            assert grams is None or any(g in b for g in grams), (a, b, need)


def test_nothing_asked_or_held(spark):
    none, held = spark.createDataFrame([], ASKED), spark.createDataFrame([("n", "name", [])], NODES)
    assert G.match_nodes(none, held, 0.5).isEmpty()
    blank = spark.createDataFrame([(0, "", "", [], 1.0), (1, "x", "x", [], 0.0)], ASKED)
    assert G.match_nodes(blank, held, 0.5).isEmpty()
    assert G.match_nodes(spark.createDataFrame([(0, "name", "name", [], 1.0)], ASKED), held.limit(0), 0.5).isEmpty()
