"""Queries over vectors and the retrieval pipeline.

Vectors stand for chunks of the documents with the same number; ``label`` is a community.
The first vectors are the queries: an original of weight 1 and two rewrites.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import evidence, graph, modes, planning, retrieval
from quillmesh.operators.vectorindex import VectorIndex
from quillmesh.plans.components import durable, shared_folder
from quillmesh.sources.tables import SQL_EVIDENCE, SQL_NODES, edge_evidence, node_names, table

VARIANTS = ((0, 1.0), (1, 0.85), (2, 0.65))
TOP, POOL, RRF_K = 10, 40, 60
#: What the graph is asked: a node's name and another's alias.
GRAPH_QUERY = 'what ties "NATION_3" to "vendor 7"'
DIMENSIONS = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))


def _queries(vectors: DataFrame, ids: list[int]) -> DataFrame:
    return vectors.filter(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _weight() -> Column:
    out = F.lit(None).cast("double")
    for i, w in VARIANTS:
        out = F.when(F.col("query_id") == i, w).otherwise(out)
    return out


def _fused(spark: SparkSession, sf_dir: str, k: int = POOL) -> DataFrame:
    v = _vectors(spark, sf_dir)
    hits = retrieval.top_inner_product(v, _queries(v, [i for i, _ in VARIANTS]), k)
    return retrieval.fuse(hits, _weight(), len(VARIANTS), RRF_K)


def topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    found = retrieval.top_inner_product(v, _queries(v, [0, 1, 2, 3, 4]), TOP)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def fused_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def drift_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all vectors are near the first."""
    some = _vectors(spark, sf_dir).select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return retrieval.keep_variants(some, 0.05).select("idx")


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x"))
    mean = at.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
    return listed.select(F.col("label").alias("group_id"), F.transform("l", lambda e: e["m"]).alias("vector"))


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities, with the vector of their number."""
    v = _vectors(spark, sf_dir)
    hits = retrieval.top_inner_product(v, _queries(v, [0]), 5).select("id", "score")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("keyword"))
    return modes.weighted_search(hits, part, 0.8, "node_id", 5).select("node_id", "keyword", F.round("score", 6).alias("score"))


def community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _centroids(spark, sf_dir)
    asked = _queries(_vectors(spark, sf_dir), [0])
    hits = retrieval.top_inner_product(groups, asked, 3, "group_id", "vector").select("id", "score")
    size = _vectors(spark, sf_dir).groupBy(F.col("label").alias("group_id")).agg(F.count("*").alias("node_count"))
    return modes.weighted_search(hits, size, 0.6, "group_id", 3).select("group_id", "node_count", F.round("score", 6).alias("score"))


def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.validation_report(table(spark, sf_dir, "embeddings"), DIMENSIONS)


def index_id_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without document, documents without vector."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return retrieval.id_difference(_vectors(spark, sf_dir), docs).select("id", "side")


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts with summaries, and vectors made of a summary that has changed for each third part."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 5 != 0")
    objects = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("summary"))
    made = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")), 256).alias("summary_hash"),
        F.when(F.col("p_partkey") % 7 == 0, "old").otherwise("new").alias("model_name"),
    )
    vectors = made.join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    return objects, vectors


def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, vectors = _summaries(spark, sf_dir)
    return retrieval.prunable_vectors(objects, vectors, DIMENSIONS, "new")


def fresh_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, vectors = _summaries(spark, sf_dir)
    return retrieval.stale_rows(objects, vectors, DIMENSIONS, "new")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits as chunks: threes of neighbouring numbers are a family of one size each."""
    scored = _fused(spark, sf_dir, 200).select(F.col("id").alias("chunk_id"), "score")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    size = F.array(F.lit("large"), F.lit("medium"), F.lit("small"))
    return scored.join(docs, "chunk_id").select(
        "chunk_id", "score", "content", F.floor(F.col("chunk_id") / 3).alias("family_id"), F.get(size, (F.col("chunk_id") % 3).cast("int")).alias("granularity")
    )


def family_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.collapse_families(_candidates(spark, sf_dir), POOL)
    return found.select("chunk_id", "family_id", "granularity", F.round("score", 6).alias("score"))


QUERY = "the and of"


def rag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.rag_query(_candidates(spark, sf_dir), QUERY, TOP, POOL, POOL, 0.6)
    return found.select("chunk_id", "family_id", F.round("effective", 6).alias("effective"), F.col("rerank_rank").cast("long").alias("rerank_rank"))


def rescue_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text holds these words: the two best of positive score are rescued."""
    variants = [("zzqx qqzz", 1.0), ("qxqx", 0.85)]
    found = retrieval.rag_query(_candidates(spark, sf_dir), variants[0][0], TOP, POOL, POOL, None, variants)
    return found.select("chunk_id", F.round("score", 6).alias("score"), "low_confidence")


def hybrid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that bear the question's terms as names or aliases are walked from; chunks linked with what is reached count more; then the pipeline."""
    terms = spark.range(1).select(planning.rule_terms(F.lit(GRAPH_QUERY))).first()[0]
    asked = planning.entity_frame(spark, [planning.Entity(t, t) for t in terms])
    hit = durable(graph.match_nodes(asked, node_names(spark, sf_dir), 0.9, fuzzy=False))
    reached = graph.distances(edge_evidence(spark, sf_dir), hit, 1)
    lines = table(spark, sf_dir, "lineitem")
    link = lambda kind, key: lines.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"))
    links = link("supplier", "l_suppkey").unionByName(link("part", "l_partkey"))
    boosted = modes.anchored(_candidates(spark, sf_dir), links, reached, 1.2)
    found = retrieval.rag_query(boosted, QUERY, TOP, POOL, POOL, 0.6)
    return found.select("chunk_id", "family_id", F.round("score", 6).alias("score"), F.round("effective", 6).alias("effective"))


def global_key_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest communities' most referenced members."""
    near = community_search(spark, sf_dir).select("group_id")
    members = _vectors(spark, sf_dir).select(F.col("vec_id").alias("node_id"), F.col("label").alias("group_id")).join(F.broadcast(near), "group_id", "left_semi")
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("ref_count"), F.max("l_quantity").alias("weight"))
    nodes = refs.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("keyword")), "node_id")
    return modes.key_entities(members, nodes, 10).select("node_id", "keyword", "ref_count", "weight")


def federated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of vectors and one that fails."""
    v = _vectors(spark, sf_dir)

    def store(rest: int):
        part = v.filter(F.col("vec_id") % 2 == rest)
        return lambda: retrieval.top_inner_product(part, _queries(v, [0]), TOP).select(F.col("id").alias("vec_id"), "score")

    def broken():
        raise OSError("no such store")

    found, _ = modes.federated({"even": store(0), "odd": store(1), "lost": broken}, "vec_id", 15)
    return found.select("store", "vec_id", F.round("federated_score", 6).alias("federated_score"))


def _index(spark: SparkSession) -> VectorIndex:
    return VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", DIMENSIONS)


def _found(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """The results as they are now; the index's folder is not needed any more."""
    found = durable(index.search(queries, TOP))
    index.drop()
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all of them, through the index of bounded blocks."""
    v, index = _vectors(spark, sf_dir), _index(spark)
    index.build(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return _found(index, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))


def vector_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after changes: a seventh of the vectors deleted, a seventh turned round, a seventh added later."""
    v, index = _vectors(spark, sf_dir), _index(spark)
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index.build(rows.filter("id % 7 != 1"))
    index.delete(rows.filter("id % 7 = 3").select("id"))
    index.replace(rows.filter("id % 7 = 5").select("id", F.reverse("vector").alias("vector")))
    index.add(rows.filter("id % 7 = 1"))
    return _found(index, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.operators.graph import relation_text
    from quillmesh.sources.tables import edge_evidence, node_names

    raw = edge_evidence(spark, sf_dir)
    nodes, edges = node_names(spark, sf_dir).filter("node_id LIKE 'nation%'"), evidence.edge_names(raw, raw.count())
    texts = relation_text(edges, node_names(spark, sf_dir))
    groups = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("summary"))
    return modes.answer_context(
        nodes, texts, texts.select(F.col("text").alias("path")), groups, _candidates(spark, sf_dir), nodes, groups
    )


QUERIES = {
    f.__name__: f
    for f in (
        topk_inner_product, fused_multi_query, drift_filter, entity_search, community_search, vector_validation, index_id_consistency,
        stale_vectors, fresh_anti_join, family_collapse, rag_query, rescue_query, hybrid_query, global_key_entities, federated_topk, answer_context,
        vector_index_search, vector_index_changes,
    )
}

_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_VARIANTS = f"variants(query_id, w) AS (VALUES {', '.join(f'({i}, {w}::DOUBLE)' for i, w in VARIANTS)})"


def _hits(k: int) -> str:
    return f"""{_VARIANTS}, hits AS (
        SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT} AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id IN (0, 1, 2)
        QUALIFY rank <= {k}
    ), fused AS (
        SELECT id, max(w * score) + sum(w / ({RRF_K} + rank)) AS score FROM hits JOIN variants USING (query_id) GROUP BY id
    )"""


_CANDIDATES = f"""{_hits(200)}, candidates AS (
    SELECT id AS chunk_id, score, text AS content, id // 3 AS family_id, id % 3 AS grain,
           ['large', 'medium', 'small'][id % 3 + 1] AS granularity
    FROM fused JOIN documents ON doc_id = id
)"""


def _collapsed(candidates: str) -> str:
    return f"""collapsed AS (
        SELECT * FROM {candidates} WHERE grain > 0
        QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY score DESC, grain DESC, chunk_id) = 1
        ORDER BY score DESC, chunk_id LIMIT {POOL}
    )"""


def _reranked(words: list[str]) -> str:
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""reranked AS (
        SELECT *, len(list_intersect({listed}, regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+'))) / {len(words)}.0 AS rerank_score FROM collapsed
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY rerank_score DESC, score DESC, chunk_id) AS rerank_rank FROM reranked
    )"""


_FLOOR = f"""CASE WHEN lower(trim(content)) = '{QUERY}' THEN 1.0 WHEN contains(regexp_replace(lower(content), '\\s+', ' ', 'g'), '{QUERY}') THEN 0.75 ELSE 0.0 END"""
_RAG = f"""kept AS (
    SELECT *, greatest(rerank_score, {_FLOOR})::DOUBLE AS effective FROM placed
    WHERE greatest(rerank_score, {_FLOOR}) >= 0.6 ORDER BY rerank_rank LIMIT {TOP}
)"""
_CENTROIDS = """flat AS (
    SELECT label::BIGINT AS group_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
), centroids AS (
    SELECT group_id, list(m ORDER BY i) AS v FROM (SELECT group_id, i, avg(x) AS m FROM flat GROUP BY ALL) GROUP BY group_id
), near_groups AS (
    SELECT c.group_id, 0.6 * list_inner_product(c.v, q.embedding::DOUBLE[]) AS score FROM centroids c, embeddings q WHERE q.vec_id = 0
    ORDER BY score DESC, c.group_id LIMIT 3
)"""
_SUMMARIES = """objects AS (
    SELECT p_partkey AS id, sha256(p_name || ' ' || p_type) AS h FROM part WHERE p_partkey % 5 <> 0
), made AS (
    SELECT p_partkey AS id, sha256(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || p_type END) AS h,
           CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE 'new' END AS model
    FROM part JOIN embeddings ON vec_id = p_partkey
)"""
ORACLE = {
    "topk_inner_product": f"""
        SELECT q.vec_id AS query_id, e.vec_id, round({_DOT}, 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id < 5 QUALIFY rank <= {TOP}
    """,
    "vector_index_search": f"""
        SELECT q.vec_id AS query_id, e.vec_id, round({_DOT}, 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= {TOP}
    """,
    "vector_index_changes": f"""
        WITH changed AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 5 THEN list_reverse(embedding) ELSE embedding END AS embedding
            FROM embeddings WHERE vec_id % 7 <> 3
        )
        SELECT q.vec_id AS query_id, e.vec_id, round({_DOT}, 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank
        FROM changed e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= {TOP}
    """,
    "fused_multi_query": f"WITH {_hits(POOL)} SELECT id AS vec_id, round(score, 6) AS score FROM fused",
    "drift_filter": """
        SELECT e.vec_id AS idx FROM embeddings e, embeddings q WHERE q.vec_id = 0
        AND (e.vec_id = 0 OR list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.05)
    """,
    "entity_search": f"""
        WITH hits AS (SELECT e.vec_id AS id, {_DOT} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 5)
        SELECT id AS node_id, p_name AS keyword, round(0.8 * score, 6) AS score FROM hits JOIN part ON p_partkey = id
    """,
    "community_search": f"""
        WITH {_CENTROIDS} SELECT group_id, count(*) AS node_count, round(any_value(score), 6) AS score
        FROM near_groups JOIN embeddings ON label = group_id GROUP BY group_id
    """,
    "vector_validation": f"""
        WITH v AS (SELECT embedding, len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS good FROM embeddings)
        SELECT count(*) AS vectors, count(*) FILTER (good) AS valid, count(*) FILTER (NOT good) AS invalid,
               count(*) FILTER (good AND list_inner_product(embedding, embedding) = 0) AS zero_norm, count(DISTINCT len(embedding)) AS dimension_count FROM v
    """,
    "index_id_consistency": """
        SELECT vec_id AS id, 'index_only' AS side FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT doc_id, 'table_only' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    """,
    "stale_vectors": f"WITH {_SUMMARIES} SELECT m.id FROM made m LEFT JOIN objects o ON m.id = o.id WHERE o.id IS NULL OR o.h <> m.h OR model <> 'new'",
    "fresh_anti_join": f"""
        WITH {_SUMMARIES} SELECT id, h AS summary_hash FROM objects o
        WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.id = o.id AND m.h = o.h AND model = 'new')
    """,
    "family_collapse": f"WITH {_CANDIDATES}, {_collapsed('candidates')} SELECT chunk_id, family_id, granularity, round(score, 6) AS score FROM collapsed",
    "rag_query": f"""
        WITH {_CANDIDATES}, {_collapsed('candidates')}, {_reranked(QUERY.split())}, {_RAG}
        SELECT chunk_id, family_id, round(effective, 6) AS effective, rerank_rank FROM kept
    """,
    "rescue_query": f"""
        WITH {_CANDIDATES}, {_collapsed('candidates')}
        SELECT chunk_id, round(score, 6) AS score, true AS low_confidence FROM collapsed WHERE score > 0 ORDER BY collapsed.score DESC, chunk_id LIMIT 2
    """,
    "hybrid_query": f"""
        WITH {_CANDIDATES}, {SQL_NODES}, {SQL_EVIDENCE}, hit AS (
            SELECT node_id FROM nodes WHERE lower(keyword) IN ('nation_3', 'vendor 7') OR len(list_filter(aliases, lambda a: lower(a) IN ('nation_3', 'vendor 7'))) > 0
        ), reached AS (
            SELECT node_id FROM hit
            UNION SELECT source_node_id FROM evidence WHERE target_node_id IN (FROM hit)
            UNION SELECT target_node_id FROM evidence WHERE source_node_id IN (FROM hit)
        ), anchors AS (
            SELECT DISTINCT l_orderkey FROM lineitem WHERE 'supplier:' || l_suppkey IN (FROM reached) OR 'part:' || l_partkey IN (FROM reached)
        ), boosted AS (
            SELECT * REPLACE (CASE WHEN l_orderkey IS NULL THEN score ELSE score * 1.2 END AS score) FROM candidates LEFT JOIN anchors ON chunk_id = l_orderkey
        ), {_collapsed('boosted')}, {_reranked(QUERY.split())}, {_RAG}
        SELECT chunk_id, family_id, round(score, 6) AS score, round(effective, 6) AS effective FROM kept
    """,
    "global_key_entities": f"""
        WITH {_CENTROIDS}, refs AS (
            SELECT l_partkey AS node_id, count(*) AS ref_count, max(l_quantity) AS weight FROM lineitem GROUP BY 1
        )
        SELECT node_id, p_name AS keyword, ref_count, weight FROM refs JOIN part ON p_partkey = node_id
        WHERE node_id IN (SELECT vec_id FROM embeddings WHERE label IN (SELECT group_id FROM near_groups))
        ORDER BY ref_count DESC, weight DESC, keyword, node_id LIMIT 10
    """,
    "federated_topk": f"""
        WITH hits AS (
            SELECT CASE WHEN e.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS store, e.vec_id, {_DOT} AS s
            FROM embeddings e, embeddings q WHERE q.vec_id = 0
            QUALIFY row_number() OVER (PARTITION BY store ORDER BY s DESC, e.vec_id) <= {TOP}
        )
        SELECT store, vec_id, round(s, 6) AS federated_score FROM hits ORDER BY s DESC, store, vec_id LIMIT 15
    """,
}
