"""Fuzzy merge candidates against all pairs in plain Python."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from quillmesh.operators import merging as M
from quillmesh.operators import organise as O


ROWS = "node_id string, keyword string, summary string, aliases array<string>"
LINKS = "edge_id string, source_node_id string, relation string, target_node_id string"


def brute(rows, links, least):
    """All pairs: score, names, ids and whether a term is shared."""
    squeeze = lambda s: " ".join(s.lower().split())
    keyword = {n: k for n, k, _, _ in rows}
    held = {n: {t for t in map(squeeze, [k, *aliases]) if t} for n, k, _, aliases in rows}
    signs = {n: set() for n in keyword}
    for _, a, r, b in links:
        signs[a].add(("out", r, squeeze(keyword[b])))
        signs[b].add(("in", r, squeeze(keyword[a])))
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    out = []
    for i, (a, _, ga, _) in enumerate(rows):
        for b, _, gb, _ in rows[i + 1 :]:
            if held[a] & held[b]:
                out.append((-1.0, keyword[a], keyword[b], a, b, "exact_term"))
                continue
            lex = max((ratio(x, y) for x in held[a] for y in held[b]), default=0.0)
            union = signs[a] | signs[b]
            jac = len(signs[a] & signs[b]) / len(union) if signs[a] and signs[b] else 0.0
            score = max(lex, 0.65 * lex + 0.2 * ratio((ga or "").lower(), (gb or "").lower()) + 0.15 * jac)
            if score >= least:
                out.append((-round(score, 9), keyword[a], keyword[b], a, b, "semantic_similarity"))
    return sorted(out)


@pytest.mark.parametrize("limit,ways", [(5, 1200), (40, 1200), (1000, 1200), (60, 4)])
def test_against_all_pairs(spark, limit, ways, monkeypatch):
    monkeypatch.setattr(M, "WAYS", ways)  # with few ways, longer names are searched by grams
    rng = random.Random(limit)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(3, 9))).strip() or "x"
    rows = [(f"n{i:02}", word().upper() if i % 7 == 0 else word(), rng.choice(["one thing", "one thin", "other", None]), [word()] * (i % 3 == 0)) for i in range(45)]
    links = [(f"e{i}", f"n{rng.randrange(45):02}", rng.choice("rs"), f"n{rng.randrange(45):02}") for i in range(60)]
    nodes, edges = spark.createDataFrame(rows, ROWS), spark.createDataFrame(links, LINKS)
    every = brute(rows, links, 0.7)
    want = [(a, b, -s) for s, _, _, a, b, why in every if why == "semantic_similarity"][:limit]
    assert [(r.a, r.b, round(r.score, 9)) for r in M.fuzzy_candidates(nodes, edges, 0.7, limit).collect()] == want
    if limit == 40:
        got = [(r.a, r.b, round(r.score, 9), r.reason) for r in M.merge_candidates(nodes, edges, 0.7, limit).collect()]
        assert got == [(a, b, -s, why) for s, _, _, a, b, why in every][:limit]


@pytest.mark.parametrize("ways", [1200, 3, 0])
def test_similar_names_are_all_found(spark, ways, monkeypatch):
    """Every pair that difflib calls similar enough is found, and by losses no pair without such a subsequence."""
    monkeypatch.setattr(M, "WAYS", ways)
    rng = random.Random(8)
    base = ["analytics platform team", "analitycs platform teams", "Customer#000000012", "a", "ab", "ba", "", "aaaa aaaa", "z" * 90, "z" * 88 + "y", "é中é中é", "é中é中"]
    made = base + ["".join(rng.choice("abc#0 ") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    made += [t[:i] + rng.choice("xyz") + t[i + 1 :] for t in made[:30] for i in [rng.randrange(len(t) + 1)]]
    names = sorted({" ".join(t.split()) for t in made})
    frame = spark.createDataFrame([(t,) for t in names], "name string")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for need in (0.5, 0.75, 0.9, 0.97):
        got = {(r.x, r.y) for r in M.similar_names(frame, need).collect()}
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if a]
        assert {p for p in pairs if max(SequenceMatcher(None, *p).ratio(), SequenceMatcher(None, *p[::-1]).ratio()) >= need} <= got
        if ways == 1200 and need > 0.7:
            assert got == {p for p in pairs if 2 * common(*p) >= (need - 1e-9) * (len(p[0]) + len(p[1]))} or max(map(len, names)) > 40
    assert M.similar_names(spark.createDataFrame([], "name string"), 0.9).isEmpty()


def test_names_are_searched_no_wider_than_the_list_needs(spark, monkeypatch):
    """A first look tells the bar, so terms aren't spread into all they turn into below it, and the spread is never written."""
    needs, written, search, keep = [], [], M.similar_names, M.durable
    monkeypatch.setattr(M, "similar_names", lambda names, need: needs.append(need) or search(names, need))
    monkeypatch.setattr(M, "durable", lambda df: written.append(df.columns) or keep(df))
    rows = [(f"n{i:02}", f"serial {i * 37:07}", "same", []) for i in range(60)]
    links = spark.createDataFrame([("e1", "n00", "r", "n01")], LINKS)
    got = M.fuzzy_candidates(spark.createDataFrame(rows, ROWS), links, 0.7, 5).collect()
    assert [(r.a, r.b, round(r.score, 9)) for r in got] == [(a, b, -s) for s, _, _, a, b, _ in brute(rows, [("e1", "n00", "r", "n01")], 0.7)[:5]]
    assert min(needs) >= (got[-1].score - 0.35) / 0.65 - 1e-6
    assert not any("h" in columns for columns in written)


def test_names_of_many_nodes_make_few_pairs(spark, monkeypatch):
    """Of two names that many nodes bear not all pairs are made; pairs that share a term stay out, common neighbours count."""
    keep, rows_of_pairs = M.durable, []

    def count(df):
        out = keep(df)
        if {"a", "b"} <= set(df.columns):
            rows_of_pairs.append(out.count())
        return out

    monkeypatch.setattr(M, "durable", count)
    rows = [(f"n{i:03}", "large ring 12" if i % 2 else "Large Ring 123", f"kind {i}", [f"own {i * 7919}"]) for i in range(120)]
    rows[0], rows[1] = (*rows[0][:3], ["shared"]), (*rows[1][:3], ["Shared"])
    rows[90], rows[71] = (*rows[90][:2], "same kind", []), (*rows[71][:2], "same kind", [])
    links = [("e1", "n090", "of", "n005"), ("e2", "n071", "of", "n005"), ("e3", "n040", "of", "n005")]
    got = M.fuzzy_candidates(spark.createDataFrame(rows, ROWS), spark.createDataFrame(links, LINKS), 0.86, 8).collect()
    want = [(a, b, -s) for s, _, _, a, b, why in brute(rows, links, 0.86) if why == "semantic_similarity"][:8]
    assert [(r.a, r.b, round(r.score, 9)) for r in got] == want and want[0][:2] == ("n071", "n090")
    assert max(rows_of_pairs) < 500


def test_names_that_lose_signs_are_not_broadcast(spark):
    """A name becomes many rows, which Spark's guess of sizes doesn't know of."""
    plan = M.similar_names(spark.createDataFrame([(f"serial {i}",) for i in range(200)], "name string"), 0.9)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_query_has_pairs_below_one(spark, sf_dir):
    from quillmesh.queries import graphs

    got = graphs.merge_candidates_fuzzy(spark, sf_dir).collect()
    assert len(got) == 200 and all(0.86 <= r.score < 1 for r in got)


def test_keys_are_composed_and_folded(spark):
    rows = [("n1", "Ｔｅａｍ Straße", None, []), ("n2", "team strasse", None, []), ("n3", "team", None, [])]
    nodes = spark.createDataFrame(rows, "node_id string, keyword string, summary string, aliases array<string>")
    assert [(r.a, r.b) for r in O.exact_merges(nodes).collect()] == [("n1", "n2")]
