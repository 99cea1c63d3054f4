"""Vector search, fusion, families, thresholds: the retrieval pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import vectors as V
from quillmesh.functions.text import lexical_score
from quillmesh.operators.vectorindex import top_of_many
from quillmesh.plans.components import durable

#: Query rows up to which they are broadcast; their vectors then take a few megabytes.
BROADCAST_QUERIES = 1000


def top_inner_product(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, id, score, rank``: the k rows of largest inner product for each query, ties to smaller ids.

    Few queries are broadcast to the rows.  For more of them, counted first, the rows are cut into blocks
    whose bounds tell which queries must look at them (``vectorindex``); rows of another length than
    the longest query then take no part.
    """
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        side = F.broadcast(queries.select("query_id", F.col("vector").alias("_q")))
        scored = base.crossJoin(side).select("query_id", F.col(id_col).alias("id"), V.dot(F.col(vector), F.col("_q")).alias("score"))
    else:
        size = queries.agg(F.max(F.size("vector"))).first()[0]
        return top_of_many(base.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")), queries, k, size)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def fuse(hits: DataFrame, weights: Column, lists: int, rrf_k: int = 60) -> DataFrame:
    """``id, score``: one list keeps weighted scores; several add reciprocal ranks to the best weighted score."""
    best = F.max(weights * F.col("score"))
    total = best if lists == 1 else best + F.sum(weights / (rrf_k + F.col("rank")))
    return hits.groupBy("id").agg(total.alias("score"))


def keep_variants(variants: DataFrame, threshold: float) -> DataFrame:
    """Variants near the original (``idx`` 0), which always stays."""
    original = variants.filter("idx = 0").select(F.col("vector").alias("_origin"))
    near = variants.crossJoin(F.broadcast(original))  # a plan has a handful of variants
    return near.filter((F.col("idx") == 0) | (V.cosine(F.col("vector"), F.col("_origin")) >= threshold)).drop("_origin")


def validation_report(vectors: DataFrame, dimensions: int, vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    good = V.is_valid(v, dimensions)
    return vectors.agg(
        F.count("*").alias("vectors"),
        F.count_if(good).alias("valid"),
        F.count_if(~good).alias("invalid"),
        F.count_if(good & (V.norm(v) == 0)).alias("zero_norm"),
        F.count_distinct(F.size(v)).alias("dimension_count"),
    )


def add_vectors(index: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """The index with new rows; ids that exist already or repeat raise."""
    doubled = new.groupBy(key).count().filter("count > 1").select(key).unionByName(new.join(index, key, "left_semi").select(key))
    if not doubled.isEmpty():
        raise ValueError("vector ids are taken")
    return index.unionByName(new)


def delete_vectors(index: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return index.join(ids.select(key), key, "left_anti")


def replace_vectors(index: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    return delete_vectors(index, new, key).unionByName(new)


def id_difference(index: DataFrame, rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """``id, side``: ids of one side only."""
    a, b = index.select(F.col(key).alias("id")), rows.select(F.col(key).alias("id"))
    return (
        a.join(b, "id", "left_anti").withColumn("side", F.lit("index_only")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("table_only")))
    )


def stale_rows(objects: DataFrame, vectors: DataFrame, dimensions: int, model: str) -> DataFrame:
    """Ids whose vector is missing or of another summary, length or model: what is to be embedded."""
    fresh = vectors.filter((F.size("vector") == dimensions) & (F.col("model_name") == model)).select("id", "summary_hash")
    return objects.select("id", F.sha2("summary", 256).alias("summary_hash")).join(fresh, ["id", "summary_hash"], "left_anti")


def prunable_vectors(objects: DataFrame, vectors: DataFrame, dimensions: int, model: str) -> DataFrame:
    """Ids of vectors whose object is gone or that no longer fit it."""
    live = objects.select("id", F.sha2("summary", 256).alias("_hash"))
    kept = (F.col("_hash") == F.col("summary_hash")) & V.is_valid(F.col("vector"), dimensions) & (F.col("model_name") == model)
    return vectors.join(live, "id", "left").filter(~F.coalesce(kept, F.lit(False))).select("id")


def best_per_chunk(hits: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates: each chunk with its best vector's score; a vector without chunk raises."""
    joined = hits.join(vectors.select(F.col("vec_id").alias("id"), "chunk_id"), "id")
    lost = joined.join(chunks, "chunk_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("a vector's chunk is missing")
    return joined.groupBy("chunk_id").agg(F.max("score").alias("score")).join(chunks, "chunk_id")


def with_family(chunks: DataFrame) -> DataFrame:
    """``family_id``: the root of each chunk's parents, however many levels; a missing parent or a cycle raises."""
    up = durable(chunks.select(F.col("chunk_id").alias("_c"), F.coalesce("parent_chunk_id", "chunk_id").alias("_top")))
    if not up.join(up.select(F.col("_c").alias("_top")), "_top", "left_anti").isEmpty():
        raise ValueError("a parent chunk is missing")
    at, reach, count = up, 1, None
    while True:  # each round doubles how far a chunk looks up
        ahead = at.select(F.col("_c").alias("_top"), F.col("_top").alias("_next"))
        step = durable(at.join(ahead, "_top").select("_c", "_next", (F.col("_next") != F.col("_top")).alias("_moved")))
        at = step.select("_c", F.col("_next").alias("_top"))
        if step.filter("_moved").isEmpty():
            break
        reach *= 2
        count = up.count() if count is None else count
        if reach > 2 * count:
            raise ValueError("parents form a cycle")
    roots = up.filter("_c = _top").select("_top")
    if not at.join(roots, "_top", "left_anti").isEmpty():
        raise ValueError("parents form a cycle")
    return chunks.join(at.select(F.col("_c").alias("chunk_id"), F.col("_top").alias("family_id")), "chunk_id").select(*chunks.columns, "family_id")


def with_context(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``context``: id, granularity and content of each row's parent, null for roots; what a reranker and an answer read."""
    parent = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.struct("chunk_id", "granularity", "content").alias("context"))
    return found.join(parent, "parent_chunk_id", "left").select(*found.columns, "context")


def read_text(rows: DataFrame) -> Column:
    """The parent's content where there is one, else the chunk's own."""
    return F.coalesce("context.content", "content") if "context" in rows.columns else F.col("content")


def collapse_families(candidates: DataFrame, pool: int) -> DataFrame:
    """Best chunk of each family; ``large`` ones count only where nothing else is; ties to the finer, then id."""
    grain = F.when(F.col("granularity") == "small", 0).when(F.col("granularity") == "medium", 1).otherwise(2)
    ranked = candidates.withColumn("_grain", grain)
    if not ranked.filter("_grain < 2").isEmpty():
        ranked = ranked.filter("_grain < 2")
    best = Window.partitionBy("family_id").orderBy(F.desc("score"), "_grain", "chunk_id")
    return ranked.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_grain").orderBy(F.desc("score"), "chunk_id").limit(pool)


def apply_threshold(reranked: DataFrame, floor: Column, threshold: float, top_k: int) -> DataFrame:
    """In the reranker's order: effective score = max(rerank, floor), at or above the threshold, first per family."""
    effective = reranked.withColumn("effective", F.greatest("rerank_score", floor)).filter(F.col("effective") >= threshold)
    first = Window.partitionBy("family_id").orderBy("rerank_rank")
    return effective.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").orderBy("rerank_rank").limit(top_k)


def overlap_rerank(candidates: DataFrame, query: str) -> DataFrame:
    """The default reranker: the share of the query's words found in the text that is read; no model is needed."""
    words = F.array_distinct(F.split(F.lower(F.lit(query)), r"\s+"))
    have = F.split(F.lower(read_text(candidates)), r"[^\p{L}\p{N}_]+")
    score = F.size(F.array_intersect(words, have)) / F.size(words)
    rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("rerank_score"), F.desc("score"), "chunk_id")
    return candidates.withColumn("rerank_score", score).withColumn("rerank_rank", F.row_number().over(rank))


def checked(reranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """A model's ranking as it is, if it names candidates only, each once, with finite scores and ranks of their own."""
    score = F.col("rerank_score").cast("double")
    odd = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")) | F.col("rerank_rank").isNull()
    told = reranked.agg(
        F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), F.countDistinct("rerank_rank").alias("ranks"), F.max(odd).alias("odd")
    ).first()
    if told["odd"] or not told["n"] == told["ids"] == told["ranks"]:
        raise ValueError("the reranker's scores must be finite, and each candidate ranked once")
    if not reranked.join(candidates.select("chunk_id"), "chunk_id", "left_anti").isEmpty():
        raise ValueError("the reranker names a chunk that is no candidate")
    return reranked


Reranker = Callable[[DataFrame, str], DataFrame]


def rag_query(
    candidates: DataFrame, query: str, top_k: int, pool: int, rerank_limit: int, threshold: float | None,
    variants: list[tuple[str, float]] | None = None, rescue: int = 2, usual: float = 0.6, rerank: Reranker = overlap_rerank,
) -> DataFrame:
    """Collapse, rerank, floor, threshold; with several variants and no given threshold the best few are rescued."""
    collapsed = collapse_families(candidates, pool)
    asked = variants or [(query, 1.0)]
    asked_for = collapsed.orderBy(F.desc("score"), "chunk_id").limit(rerank_limit)
    reranked = rerank(asked_for, query) if rerank is overlap_rerank else checked(durable(rerank(asked_for, query)), asked_for)
    scores = [lexical_score(F.lit(text), F.col("content")) * weight for text, weight in asked]
    floor = scores[0] if len(scores) == 1 else F.greatest(*scores)
    found = apply_threshold(reranked, floor, usual if threshold is None else threshold, top_k)
    if threshold is None and len(asked) > 1 and found.isEmpty():
        best = reranked.withColumn("effective", F.greatest("rerank_score", floor)).filter("score > 0")
        return best.orderBy(F.desc("score"), "chunk_id").limit(rescue).withColumn("low_confidence", F.lit(True))
    return found.withColumn("low_confidence", F.lit(False))
