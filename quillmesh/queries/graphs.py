"""Queries over the graph: evidence, search, merging, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import norm_key
from quillmesh.operators import evidence, graph, merging, organise, planning
from quillmesh.sources.tables import SQL_EDGES, SQL_EVIDENCE, SQL_NODES, edge_evidence, node_names, table

START = "nation:3"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = edge_evidence(spark, sf_dir)
    return evidence.edge_aggregate(raw, raw.count())


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = evidence.node_aggregate(evidence.node_bindings(edge_evidence(spark, sf_dir)))
    return node_names(spark, sf_dir).join(weights, "node_id")


def node_evidence_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.node_aggregate(evidence.node_bindings(edge_evidence(spark, sf_dir)))


def edge_evidence_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("edge_id", F.round("weight", 6).alias("weight"), "support_count")


def evidence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines are old evidence, even ones new."""
    lines = table(spark, sf_dir, "lineitem")
    made = lines.groupBy(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("source_id"), (F.col("l_linenumber") % 2).alias("old")).agg(
        F.max("l_discount").alias("evidence_weight"), F.concat(F.lit("h"), F.max("l_orderkey").cast("string")).alias("content_hash"), F.max("l_shipdate").cast("date").cast("string").alias("evidence")
    )
    made = made.withColumn("evidence", F.when(F.col("old") == 1, F.concat("evidence", F.lit(" first"))).otherwise(F.col("evidence")))
    return evidence.upsert_bindings(made.filter("old = 1").drop("old"), made.filter("old = 0").drop("old"), ["node_id", "source_id"])


def entity_resolution_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions named like parts: reuse a node only where one alone shares the name."""
    nodes = node_names(spark, sf_dir).filter("node_id LIKE 'part:%'")
    mentions = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("mention_id"),
        F.upper(F.concat_ws(" ", "p_name", ((F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(5000)) % 1500).cast("string"))).alias("keyword"),
        F.expr("cast(array() AS array<string>)").alias("aliases"),
    )
    return evidence.resolve_mentions(mentions, nodes, norm_key)


def chunk_node_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id")
    stale = F.when(F.col("doc_id") % 4 == 0, F.lit("other")).otherwise(F.md5("text"))
    sources = docs.select(
        F.col("doc_id").alias("source_id"), F.md5("text").alias("content_hash"), F.md5("text").alias("graph_hash"), stale.alias("rag_hash"),
        F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("graph_status"), F.lit("ready").alias("rag_status"),
    )
    chunks = docs.select(F.col("doc_id").alias("source_id"), F.explode(F.array(*[F.concat(F.col("doc_id").cast("string"), F.lit(f":{i}")) for i in range(2)])).alias("chunk_id"))
    nodes = evidence.node_bindings(edge_evidence(spark, sf_dir)).select("node_id", "source_id")
    return evidence.chunk_links(chunks, nodes, sources)


def _entities(spark: SparkSession) -> DataFrame:
    said = [
        planning.Entity("NATION_3", "NATION_3", (), 1.0),
        planning.Entity("vendor 7", "seven", (), 0.95),
        planning.Entity("America", "america", ("us",), 0.9),
        planning.Entity("Supplier#0000000", "Supplier#0000000", (), 0.8),
    ]
    return planning.entity_frame(spark, said)


def node_match_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.match_nodes(_entities(spark), node_names(spark, sf_dir), 0.6, fuzzy=False).select("node_id", "keyword", F.round("score", 6).alias("score"))


def node_match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = planning.entity_frame(spark, [planning.Entity("Suplier#00000009", "Suplier#00000009", (), 1.0), planning.Entity("smal ring", "smal ring", (), 1.0)])
    return graph.match_nodes(asked, node_names(spark, sf_dir), 0.7)


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.neighbours(_edges(spark, sf_dir), START)
    return found.select("near", "direction", "edge_id")


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("region:1", 1), (START, 2)], "node_id string, ord long")


def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    visited = graph.distances(edge_evidence(spark, sf_dir), _start(spark), 3)
    return visited.select("node_id", F.col("depth").cast("long").alias("depth"))


def bfs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, touched = graph.expand(_edges(spark, sf_dir), _start(spark), 2)
    return touched.select("edge_id", F.col("hop").cast("long").alias("hop"))


def bfs_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    visited, _ = graph.expand(edges, _start(spark), 2)
    return graph.paths(visited, edges, node_names(spark, sf_dir)).select("path", "weight", F.array_join("edge_ids", ",").alias("edge_ids"))


def paths_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.readable_paths(_edges(spark, sf_dir), START)
    return found.select(F.col("hops").cast("long").alias("hops"), F.array_join("edge_ids", ",").alias("edge_ids"), F.array_join("nodes", ",").alias("nodes"))


def paths_two_hop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a supplier, which has relations of both kinds."""
    found = graph.readable_paths(_edges(spark, sf_dir), "supplier:5")
    return found.select(F.col("hops").cast("long").alias("hops"), F.array_join("edge_ids", ",").alias("edge_ids"), F.array_join("nodes", ",").alias("nodes"))


def relations_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_text(_edges(spark, sf_dir), node_names(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are groups of their customers and suppliers."""
    return edge_evidence(spark, sf_dir).filter("relation IN ('lives_in', 'based_in')").select(F.col("target_node_id").alias("group_id"), F.col("source_node_id").alias("node_id"))


def groups_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all suppliers."""
    return graph.groups_of(_members(spark, sf_dir), node_names(spark, sf_dir).filter("node_id LIKE 'supplier:%'"))


def neighborhood_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _, _ = graph.neighbourhood(_edges(spark, sf_dir), START, 3, node_limit=60)
    return nodes.select("node_id", F.col("depth").cast("long").alias("depth"))


def neighborhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _, _ = graph.neighbourhood(_edges(spark, sf_dir), START, 2, node_limit=60, edge_limit=40)
    return edges.select("edge_id")


def neighborhood_bounded_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _, _ = graph.neighbourhood(_edges(spark, sf_dir), "supplier:5", 3, node_limit=1000)
    return nodes.select("node_id", F.col("depth").cast("long").alias("depth"))


def neighborhood_edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _, _ = graph.neighbourhood(_edges(spark, sf_dir), "supplier:5", 2, node_limit=1000, edge_limit=5000)
    return edges.select("edge_id")


def node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of a node, both ways, by name."""
    near = graph.neighbours(_edges(spark, sf_dir), "supplier:5")
    names = node_names(spark, sf_dir).select(F.col("node_id").alias("near"), "keyword")
    return near.join(names, "near").select("direction", "relation", "near", "keyword", F.round("weight", 6).alias("weight"), "support_count")


def relation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of a supplier with all their evidence."""
    edges = _edges(spark, sf_dir).filter("source_node_id = 'supplier:5' OR target_node_id = 'supplier:5'")
    found = graph.relation_detail(edges, evidence.edge_bindings(edge_evidence(spark, sf_dir)), node_names(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "evidence_weight")})


def full_graph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.operators.listing import with_members

    nations = node_names(spark, sf_dir).filter("node_id LIKE 'nation:%'").select(F.col("node_id").alias("group_id"), "keyword")
    return with_members(nations, _members(spark, sf_dir), "group_id", "node_id", "members").select("group_id", "keyword", F.array_join("members", ",").alias("members"))


def entity_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.search_entities(_nodes(spark, sf_dir), "vendor 1", 25)
    return found.select("node_id", "keyword", F.col("class").cast("long").alias("class"), "ref_count")


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose path holds a text, with the nodes they bind."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    hits = docs.filter(F.lower("path").contains("src1/1"))
    return hits.join(evidence.node_bindings(edge_evidence(spark, sf_dir)), "source_id").select("source_id", "path", "node_id")


def graph_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = graph.filter_graph(_nodes(spark, sf_dir), _edges(spark, sf_dir), min_weight=0.95, min_refs=25, min_edge_weight=0.98, relation="supplies")
    return edges.select("edge_id", F.round("weight", 6).alias("weight"), "support_count")


def draft_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand as drafts of sections: entities that share a term become one."""
    nodes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("keyword"), F.array("p_type").alias("aliases")
    )
    pairs = organise.exact_merges(nodes)
    from quillmesh.plans.components import connected_components

    return connected_components(pairs).select(F.col("node").alias("node_id"), "component")


def neighbor_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.neighbour_signatures(edge_evidence(spark, sf_dir), node_names(spark, sf_dir))


def neighbor_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with neighbouring numbers."""
    pairs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") + 1).cast("string")).alias("b")
    )
    of = pairs.select(F.explode(F.array("a", "b")).alias("node_id"))
    found = organise.neighbour_jaccard(pairs, organise.neighbour_signatures(edge_evidence(spark, sf_dir), node_names(spark, sf_dir), of=of))
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def merge_candidates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.exact_candidates(node_names(spark, sf_dir), 200).select("a", "b", "score")


def merge_candidates_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of all pairs of all nodes that share no term."""
    return merging.fuzzy_candidates(node_names(spark, sf_dir), edge_evidence(spark, sf_dir), 0.86)


def keep_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of suppliers of a nation the one to keep."""
    nodes = _nodes(spark, sf_dir)
    groups = edge_evidence(spark, sf_dir).filter("relation = 'based_in'").select(F.col("target_node_id").alias("group_id"), F.col("source_node_id").alias("node_id"))
    return organise.keep_nodes(groups, nodes)


def node_merge_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers s and s + 1 merge for even s: evidence moves to the even one."""
    supplier = table(spark, sf_dir, "supplier")
    moves = supplier.select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node_id"),
        F.concat(F.lit("supplier:"), (F.col("s_suppkey") - F.col("s_suppkey") % 2).cast("string")).alias("keep_id"),
    )
    raw = edge_evidence(spark, sf_dir)
    rows = raw.count()
    merged = evidence.edge_aggregate(organise.redirected(raw, moves, rows), rows)
    return merged.select("edge_id", F.round("weight", 6).alias("weight"), "support_count")


def _families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers in chains of ten and suppliers in stars of ten."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    chain = c.filter("c_custkey % 10 != 9").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    star = s.filter("s_suppkey % 10 != 0").select((F.col("s_suppkey") - F.col("s_suppkey") % 10).alias("a"), F.col("s_suppkey").alias("b"))
    name = lambda kind, x: F.concat(F.lit(kind), F.lpad(F.col(x).cast("string"), 9, "0"))
    edges = chain.select(name("c", "a").alias("source_node_id"), name("c", "b").alias("target_node_id")).unionByName(
        star.select(name("s", "a").alias("source_node_id"), name("s", "b").alias("target_node_id"))
    )
    nodes = c.select(name("c", "c_custkey").alias("node_id")).unionByName(s.select(name("s", "s_suppkey").alias("node_id"))).unionByName(
        table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node_id"))
    )
    return nodes, edges


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.components(*_families(spark, sf_dir))


def qualified_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _families(spark, sf_dir)
    return organise.qualified(organise.components(nodes, edges), edges)


def community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _families(spark, sf_dir)
    return organise.community_stats(organise.components(nodes, edges), edges)


QUERIES = {
    f.__name__: f
    for f in (
        node_evidence_agg, edge_evidence_agg, evidence_upsert, entity_resolution_unique, chunk_node_links, node_match_lexical, node_match_fuzzy,
        paths_two_hop_all, neighborhood_bounded_all, neighborhood_edges_all,
        neighbors, bfs_distance, bfs_edges, bfs_paths, paths_two_hop, relations_text, groups_of_nodes, neighborhood_bounded, neighborhood_edges,
        node_detail, relation_detail, full_graph_groups, entity_search_ranked, document_search, graph_filters, draft_merge, neighbor_signatures, neighbor_jaccard,
        merge_candidates_exact, merge_candidates_fuzzy, keep_node, node_merge_rewire, connected_components, qualified_communities, community_stats,
    )
}

#: Second names of queries that read subsets once and now read whole tables under both.
ALIASES = {
    "entity_resolution_all": "entity_resolution_unique", "groups_of_nodes_all": "groups_of_nodes", "draft_merge_all": "draft_merge",
    "bfs_distance_all": "bfs_distance", "bfs_edges_all": "bfs_edges", "neighbor_signatures_all": "neighbor_signatures",
}
QUERIES |= {second: QUERIES[name] for second, name in ALIASES.items()}

_BOUND = """bound AS (
    SELECT node_id, source_id, max(evidence_weight) AS w FROM (
        SELECT source_node_id AS node_id, source_id, evidence_weight FROM evidence UNION ALL SELECT target_node_id, source_id, evidence_weight FROM evidence
    ) GROUP BY ALL
), weights AS (SELECT node_id, max(w) AS weight, count(*) AS ref_count FROM bound GROUP BY node_id)"""
_NEAR = """near AS (
    SELECT source_node_id AS here, target_node_id AS near, 'forward' AS direction, 0 AS dir_rank, edge_id FROM {t}
    UNION ALL SELECT target_node_id, source_node_id, 'backward', 1, edge_id FROM {t}
)"""


def _reach(starts: str, depth: int) -> str:
    return f"""walk(node_id, depth) AS (
        SELECT * FROM (VALUES {starts}) UNION
        SELECT near, depth + 1 FROM walk JOIN near ON here = node_id WHERE depth < {depth}
    ), dist AS (SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id)"""


_TWO = f"('region:1', 0), ('{START}', 0)"
_MEMBERS = "members AS (SELECT target_node_id AS group_id, source_node_id AS node_id FROM evidence WHERE relation IN ('lives_in', 'based_in'))"
_SIGNED = """signed AS (
    SELECT source_node_id AS node_id, 'out:' || lower(relation) || ':' || lower(keyword) AS signature FROM {t} JOIN nodes ON target_node_id = node_id
    UNION SELECT target_node_id, 'in:' || lower(relation) || ':' || lower(keyword) FROM {t} JOIN nodes ON source_node_id = node_id
)"""
_ALL_NEAR = _NEAR.format(t="edges")
_FAMILIES = """links AS (
    SELECT 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS a, 'c' || lpad((c_custkey + 1)::VARCHAR, 9, '0') AS b FROM customer WHERE c_custkey % 10 <> 9
    UNION ALL SELECT 's' || lpad((s_suppkey - s_suppkey % 10)::VARCHAR, 9, '0'), 's' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier WHERE s_suppkey % 10 <> 0
), everyone AS (
    SELECT 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS node_id FROM customer UNION ALL SELECT 's' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier
    UNION ALL SELECT 'n' || lpad(n_nationkey::VARCHAR, 9, '0') FROM nation
), both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(node_id, other) AS (
    SELECT node_id, node_id FROM everyone UNION SELECT reach.node_id, b FROM reach JOIN both_ ON other = a
), comp AS (SELECT node_id, min(other) AS component FROM reach GROUP BY node_id),
sizes AS (SELECT component, count(*) AS node_count FROM comp GROUP BY component)"""
_ASKED = """asked(normalized, text, alias, confidence) AS (VALUES
    ('nation_3', 'nation_3', '', 1.0), ('seven', 'vendor 7', '', 0.95), ('america', 'america', 'us', 0.9), ('supplier#0000000', 'supplier#0000000', '', 0.8))"""
ORACLE = {
    "node_evidence_agg": f"WITH {SQL_EVIDENCE}, {_BOUND} SELECT node_id, weight, ref_count FROM weights",
    "edge_evidence_agg": f"WITH {SQL_EVIDENCE}, {SQL_EDGES} SELECT edge_id, round(weight, 6) AS weight, support_count FROM edges",
    "evidence_upsert": """
        WITH made AS (
            SELECT l_partkey AS node_id, l_suppkey AS source_id, l_linenumber % 2 AS old, max(l_discount) AS w, 'h' || max(l_orderkey) AS h,
                   strftime(max(l_shipdate), '%Y-%m-%d') || CASE WHEN l_linenumber % 2 = 1 THEN ' first' ELSE '' END AS e
            FROM lineitem GROUP BY 1, 2, 3
        )
        SELECT node_id, source_id, max(w) AS evidence_weight, arg_min(h, old) AS content_hash, arg_max(e, length(e) * 2 + (1 - old)) AS evidence
        FROM made GROUP BY 1, 2
    """,
    "entity_resolution_unique": f"""
        WITH {SQL_NODES}, terms AS (
            SELECT DISTINCT node_id, lower(t) AS term FROM (SELECT node_id, unnest(list_append(aliases, keyword)) AS t FROM nodes WHERE node_id LIKE 'part:%')
        ), m AS (
            SELECT p_partkey AS mention_id, lower(p_name || ' ' || ((p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 5000 END) % 1500)) AS k FROM part
        ), hits AS (SELECT mention_id, k, count(DISTINCT node_id) AS n, min(node_id) AS hit FROM m LEFT JOIN terms ON term = k GROUP BY ALL)
        SELECT mention_id, CASE WHEN n = 1 THEN hit ELSE 'new:' || substr(sha256(k), 1, 16) END AS node_id FROM hits
    """,
    "chunk_node_links": f"""
        WITH {SQL_EVIDENCE}, {_BOUND}, ready AS (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 4 <> 0)
        SELECT DISTINCT doc_id || ':' || i AS chunk_id, node_id FROM ready JOIN bound ON source_id = doc_id, (VALUES (0), (1)) t(i)
    """,
    "node_match_lexical": f"""
        WITH {SQL_NODES}, {_ASKED}, pairs AS (
            SELECT node_id, keyword, confidence::DOUBLE AS confidence, lower(keyword) AS k, list_transform(aliases, lambda x: lower(x)) AS al, normalized AS p,
                   list_filter([text, alias], lambda x: x <> '') AS alt FROM nodes, asked
        ), scored AS (
            SELECT node_id, keyword, confidence * CASE WHEN p = k THEN 1.0
                WHEN list_contains(al, p) OR list_contains(alt, k) OR list_has_any(al, alt) THEN 0.9
                WHEN len(list_filter(list_append(alt, p), lambda a: len(list_filter(list_append(al, k), lambda h:
                    least(length(a), length(h)) >= 2 AND (contains(a, h) OR contains(h, a)))) > 0)) > 0 THEN 0.85 END AS score FROM pairs
        )
        SELECT node_id, keyword, round(max(score), 6) AS score FROM scored WHERE score >= 0.6 GROUP BY ALL
    """,
    "neighbors": f"WITH {SQL_EVIDENCE}, {SQL_EDGES}, {_NEAR.format(t='edges')} SELECT near, direction, edge_id FROM near WHERE here = '{START}'",
    "bfs_distance": f"WITH RECURSIVE {SQL_EVIDENCE}, {SQL_EDGES}, {_ALL_NEAR}, {_reach(_TWO, 3)} SELECT node_id, depth FROM dist",
    "bfs_edges": f"""
        WITH RECURSIVE {SQL_EVIDENCE}, {SQL_EDGES}, {_ALL_NEAR}, {_reach(_TWO, 2)}
        SELECT edge_id, min(depth) + 1 AS hop FROM near JOIN dist ON here = node_id WHERE depth < 2 GROUP BY edge_id
    """,
    "paths_two_hop": f"""
        WITH {SQL_EVIDENCE}, {SQL_EDGES}, found AS (
            SELECT 1 AS hops, edge_id AS edge_ids, source_node_id || ',' || target_node_id AS nodes, [edge_id] AS o FROM edges WHERE '{START}' IN (source_node_id, target_node_id)
            UNION ALL SELECT 2, a.edge_id || ',' || b.edge_id, concat_ws(',', a.source_node_id, a.target_node_id, b.target_node_id), [a.edge_id, b.edge_id]
            FROM edges a JOIN edges b ON a.target_node_id = b.source_node_id
            WHERE '{START}' IN (a.source_node_id, a.target_node_id, b.target_node_id)
              AND a.source_node_id <> a.target_node_id AND b.source_node_id <> b.target_node_id AND a.source_node_id <> b.target_node_id
        )
        SELECT hops, edge_ids, nodes FROM found ORDER BY hops, o LIMIT 20
    """,
    "paths_two_hop_all": f"""
        WITH {SQL_EVIDENCE}, {SQL_EDGES}, found AS (
            SELECT 1 AS hops, edge_id AS edge_ids, source_node_id || ',' || target_node_id AS nodes, [edge_id] AS o FROM edges WHERE 'supplier:5' IN (source_node_id, target_node_id)
            UNION ALL SELECT 2, a.edge_id || ',' || b.edge_id, concat_ws(',', a.source_node_id, a.target_node_id, b.target_node_id), [a.edge_id, b.edge_id]
            FROM edges a JOIN edges b ON a.target_node_id = b.source_node_id
            WHERE 'supplier:5' IN (a.source_node_id, a.target_node_id, b.target_node_id)
              AND a.source_node_id <> a.target_node_id AND b.source_node_id <> b.target_node_id AND a.source_node_id <> b.target_node_id
        )
        SELECT hops, edge_ids, nodes FROM found ORDER BY hops, o LIMIT 20
    """,
    "neighborhood_bounded_all": f"""
        WITH RECURSIVE {SQL_EVIDENCE}, {SQL_EDGES}, {_ALL_NEAR}, {_reach("('supplier:5', 0)", 3)}
        SELECT node_id, depth FROM dist ORDER BY depth, node_id LIMIT 1000
    """,
    "neighborhood_edges_all": f"""
        WITH RECURSIVE {SQL_EVIDENCE}, {SQL_EDGES}, {_ALL_NEAR}, {_reach("('supplier:5', 0)", 2)},
        kept AS (SELECT node_id FROM dist ORDER BY depth, node_id LIMIT 1000)
        SELECT edge_id FROM edges WHERE source_node_id IN (FROM kept) AND target_node_id IN (FROM kept) ORDER BY edge_id LIMIT 5000
    """,
    "relations_text": f"""
        WITH {SQL_NODES}, {SQL_EVIDENCE}, {SQL_EDGES}
        SELECT edge_id, a.keyword || '->[' || relation || ']->' || b.keyword AS text
        FROM edges JOIN nodes a ON a.node_id = source_node_id JOIN nodes b ON b.node_id = target_node_id
    """,
    "groups_of_nodes": f"WITH {SQL_EVIDENCE}, {_MEMBERS} SELECT DISTINCT group_id FROM members WHERE node_id LIKE 'supplier:%'",
    "neighborhood_bounded": f"""
        WITH RECURSIVE {SQL_EVIDENCE}, {SQL_EDGES}, {_ALL_NEAR}, {_reach(f"('{START}', 0)", 3)}
        SELECT node_id, depth FROM dist ORDER BY depth, node_id LIMIT 60
    """,
    "neighborhood_edges": f"""
        WITH RECURSIVE {SQL_EVIDENCE}, {SQL_EDGES}, {_ALL_NEAR}, {_reach(f"('{START}', 0)", 2)},
        kept AS (SELECT node_id FROM dist ORDER BY depth, node_id LIMIT 60)
        SELECT edge_id FROM edges WHERE source_node_id IN (FROM kept) AND target_node_id IN (FROM kept) ORDER BY edge_id LIMIT 40
    """,
    "node_detail": f"""
        WITH {SQL_NODES}, {SQL_EVIDENCE}, {SQL_EDGES}
        SELECT 'forward' AS direction, relation, node_id AS near, keyword, round(weight, 6) AS weight, support_count
        FROM edges JOIN nodes ON node_id = target_node_id WHERE source_node_id = 'supplier:5'
        UNION ALL SELECT 'backward', relation, node_id, keyword, round(weight, 6), support_count
        FROM edges JOIN nodes ON node_id = source_node_id WHERE target_node_id = 'supplier:5'
    """,
    "relation_detail": f"""
        WITH {SQL_NODES}, {SQL_EVIDENCE}, {SQL_EDGES}, told AS (
            SELECT concat_ws('|', source_node_id, relation, target_node_id) AS edge_id, source_id, max(evidence_weight) AS w FROM evidence GROUP BY ALL
        )
        SELECT edge_id, a.keyword AS source, relation, b.keyword AS target, round(weight, 6) AS weight, support_count, source_id, round(w, 6) AS evidence_weight
        FROM edges JOIN told USING (edge_id) JOIN nodes a ON a.node_id = source_node_id JOIN nodes b ON b.node_id = target_node_id
        WHERE 'supplier:5' IN (source_node_id, target_node_id)
    """,
    "full_graph_groups": f"""
        WITH {SQL_EVIDENCE}, {_MEMBERS}
        SELECT 'nation:' || n_nationkey AS group_id, n_name AS keyword, coalesce(string_agg(DISTINCT node_id, ',' ORDER BY node_id), '') AS members
        FROM nation LEFT JOIN members ON group_id = 'nation:' || n_nationkey GROUP BY 1, 2
    """,
    "entity_search_ranked": f"""
        WITH {SQL_NODES}, {SQL_EVIDENCE}, {_BOUND}, found AS (
            SELECT node_id, keyword, ref_count, CASE WHEN lower(keyword) = 'vendor 1' THEN 0 WHEN contains(lower(keyword), 'vendor 1') THEN 1
                WHEN len(list_filter(aliases, lambda a: contains(lower(a), 'vendor 1'))) > 0 THEN 2 END AS class
            FROM nodes JOIN weights USING (node_id)
        )
        SELECT node_id, keyword, class, ref_count FROM found WHERE class IS NOT NULL ORDER BY class, ref_count DESC, keyword, node_id LIMIT 25
    """,
    "document_search": f"""
        WITH {SQL_EVIDENCE}, {_BOUND}
        SELECT source_id, source || '/' || doc_id AS path, node_id FROM documents JOIN bound ON source_id = doc_id WHERE contains(lower(source || '/' || doc_id), 'src1/1')
    """,
    "graph_filters": f"""
        WITH {SQL_EVIDENCE}, {SQL_EDGES}, {_BOUND}, seen AS (SELECT node_id FROM weights WHERE weight >= 0.95 AND ref_count >= 25)
        SELECT edge_id, round(weight, 6) AS weight, support_count FROM edges
        WHERE relation = 'supplies' AND weight >= 0.98 AND source_node_id IN (FROM seen) AND target_node_id IN (FROM seen)
    """,
    "draft_merge": """
        WITH RECURSIVE t AS (
            SELECT DISTINCT 'm' || p_partkey AS node_id, lower(x) AS term FROM (SELECT p_partkey, unnest([p_name, p_type]) AS x FROM part)
        ), firsts AS (SELECT term, min(node_id) AS a FROM t GROUP BY term), link AS (
            SELECT DISTINCT a, node_id AS b FROM t JOIN firsts USING (term) WHERE node_id <> a
        ), both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(node_id, other) AS (
            SELECT DISTINCT a, a FROM both_ UNION SELECT r.node_id, b FROM reach r JOIN both_ ON other = a
        )
        SELECT node_id, min(other) AS component FROM reach GROUP BY node_id
    """,
    "neighbor_signatures": f"WITH {SQL_NODES}, {SQL_EVIDENCE}, {SQL_EDGES}, {_SIGNED.format(t='edges')} SELECT node_id, signature FROM signed",
    "neighbor_jaccard": f"""
        WITH {SQL_NODES}, {SQL_EVIDENCE}, {SQL_EDGES}, {_SIGNED.format(t='edges')}, size AS (SELECT node_id, count(*) AS n FROM signed GROUP BY 1),
        pairs AS (SELECT 'supplier:' || s_suppkey AS a, 'supplier:' || (s_suppkey + 1) AS b FROM supplier),
        shared AS (SELECT a, b, count(*) AS c FROM pairs JOIN signed x ON x.node_id = a JOIN signed y ON y.node_id = b AND x.signature = y.signature GROUP BY a, b)
        SELECT a, b, round(CASE WHEN p.n IS NULL OR q.n IS NULL THEN 0 ELSE coalesce(c, 0) / (p.n + q.n - coalesce(c, 0)) END, 6) AS jaccard
        FROM pairs LEFT JOIN shared USING (a, b) LEFT JOIN size p ON p.node_id = a LEFT JOIN size q ON q.node_id = b
    """,
    "merge_candidates_exact": f"""
        WITH {SQL_NODES}, t AS (
            SELECT DISTINCT node_id, keyword, lower(x) AS term FROM (SELECT node_id, keyword, unnest(list_append(aliases, keyword)) AS x FROM nodes)
        )
        SELECT a, b, 1.0::DOUBLE AS score FROM (
            SELECT DISTINCT x.node_id AS a, y.node_id AS b, x.keyword AS ak, y.keyword AS bk FROM t x JOIN t y ON x.term = y.term AND x.node_id < y.node_id
        ) ORDER BY ak, bk, a, b LIMIT 200
    """,
    "keep_node": f"""
        WITH {SQL_NODES}, {SQL_EVIDENCE}, {_BOUND}, g AS (
            SELECT target_node_id AS group_id, source_node_id AS node_id FROM evidence WHERE relation = 'based_in'
        ), best AS (
            SELECT group_id, node_id AS keep_id FROM g JOIN weights USING (node_id) JOIN nodes USING (node_id)
            QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ref_count DESC, weight DESC, length(keyword), node_id) = 1
        )
        SELECT node_id, keep_id FROM g JOIN best USING (group_id)
    """,
    "node_merge_rewire": f"""
        WITH {SQL_EVIDENCE}, moved AS (
            SELECT CASE WHEN source_node_id LIKE 'supplier:%' THEN 'supplier:' || (substr(source_node_id, 10)::BIGINT - substr(source_node_id, 10)::BIGINT % 2) ELSE source_node_id END AS s,
                   relation, target_node_id AS t, source_id, evidence_weight FROM evidence
        )
        SELECT concat_ws('|', s, relation, t) AS edge_id, round(max(evidence_weight), 6) AS weight, count(DISTINCT source_id) AS support_count FROM moved GROUP BY s, relation, t
    """,
    "connected_components": f"WITH RECURSIVE {_FAMILIES} SELECT node_id, component FROM comp",
    "qualified_communities": f"""
        WITH RECURSIVE {_FAMILIES}, dist(u, v, d) AS (
            SELECT node_id, node_id, 0 FROM everyone UNION SELECT u, b, d + 1 FROM dist JOIN both_ ON v = a WHERE d < 2
        ), within AS (SELECT component, count(*) AS n FROM (SELECT DISTINCT u, v FROM dist) JOIN comp ON u = node_id GROUP BY component)
        SELECT component, node_count FROM sizes JOIN within USING (component) WHERE node_count >= 3 AND n < node_count * node_count
    """,
    "community_stats": f"""
        WITH RECURSIVE {_FAMILIES}, inside AS (SELECT component, count(*) AS m FROM links JOIN comp ON a = node_id GROUP BY component)
        SELECT component, node_count, coalesce(m, 0) AS edge_count FROM sizes LEFT JOIN inside USING (component)
    """,
}
ORACLE |= {second: ORACLE[name] for second, name in ALIASES.items() if name in ORACLE}
