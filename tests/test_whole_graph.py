"""Walks over all relations, the dense one from suppliers to parts included."""

from __future__ import annotations

from collections import defaultdict

from quillmesh import catalog
from quillmesh.sources.tables import edge_evidence, node_names


def test_paths_follow_every_relation(spark, sf_dir):
    weight: dict[tuple, float] = {}
    for r in edge_evidence(spark, sf_dir).collect():
        key = (r.source_node_id, r.relation, r.target_node_id)
        weight[key] = max(weight.get(key, 0.0), r.evidence_weight)
    name = {r.node_id: r.keyword for r in node_names(spark, sf_dir).collect()}
    near = defaultdict(list)
    for key in weight:
        near[key[0]].append((0, "|".join(key), key[2], key))
        near[key[2]].append((1, "|".join(key), key[0], key))
    trace = {"region:1": [], "nation:3": []}
    frontier, want = list(trace), []
    for _ in range(2):
        found = []
        for at in frontier:
            for way, _, to, key in sorted(near[at]):
                if to not in trace:
                    trace[to] = [*trace[at], (way, at, to, key)]
                    found.append(to)
        frontier = found
    for to in frontier:
        steps = trace[to]
        if all(way for way, *_ in steps):
            steps = [(0, b, a, key) for _, a, b, key in reversed(steps)]
        text = name[steps[0][1]]
        for way, _, b, key in steps:
            text += (f"<-[{key[1]}]<-" if way else f"->[{key[1]}]->") + name[b]
        want.append((text, round(min(weight[key] for *_, key in steps), 9), ",".join("|".join(key) for *_, key in steps)))
    got = [(r.path, round(r.weight, 9), r.edge_ids) for r in catalog.QUERIES["bfs_paths"](spark, sf_dir).collect()]
    assert got == want[:50]
    assert any("[supplies]" in path for path, _, _ in got)


def test_parts_are_reached(spark, sf_dir):
    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    for query in ("bfs_distance_all", "neighborhood_bounded_all", "neighbor_signatures_all"):
        assert run(query).filter("node_id LIKE 'part:%'").count() > 0, query
    for query in ("bfs_edges_all", "neighborhood_edges_all"):
        assert run(query).filter("edge_id LIKE '%|supplies|%'").count() > 0, query
    assert run("paths_two_hop_all").filter("edge_ids LIKE '%|supplies|%'").count() > 0


def test_drafts_of_all_parts_merge(spark, sf_dir, tmp_path):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = 600
    made = spark.range(n).selectExpr("id AS p_partkey", "concat('name ', id % 400) AS p_name", "concat('type ', id % 7 + 10 * (id % 2)) AS p_type")
    other = [c for c in part.columns if c not in made.columns]
    made.selectExpr(*made.columns, *[f"cast(NULL AS {dict(part.dtypes)[c]}) AS {c}" for c in other]).write.parquet(str(tmp_path / "part.parquet"))
    for place in (sf_dir, str(tmp_path)):
        rows = {f"m{r.p_partkey}": {r.p_name.lower(), r.p_type.lower()} for r in spark.read.parquet(f"{place}/part.parquet").collect()}
        group = {m: {m} for m in rows}
        of_term: dict[str, str] = {}
        for m, terms in rows.items():
            for t in terms:
                other_one = of_term.setdefault(t, m)
                if group[m] is not group[other_one]:
                    group[m] |= group[other_one]
                    for x in group[other_one]:
                        group[x] = group[m]
        want = {m: min(g) for m, g in group.items() if len(g) > 1}
        got = catalog.QUERIES["draft_merge_all"](spark, place).collect()
        assert {r.node_id: r.component for r in got} == want and len(got) == len(want)
    assert len(want) == n  # parts 500 and above take part


def test_no_part_or_supplier_is_left_out(spark, sf_dir):
    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    part, nodes = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    assert run("entity_resolution_all").count() == part.count()
    assert {r.group_id for r in run("groups_of_nodes_all").collect()} == {f"nation:{r.s_nationkey}" for r in nodes.collect()}
