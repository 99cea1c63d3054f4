"""Evidence bindings and what is derived from them: weights, counts, nodes and edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that one task sorts or groups where their number is known.
TASK_ROWS = 250_000
#: Rows up to which a table of nodes is broadcast; their number is always counted before.
FEW_NODES = 500_000
EDGE = ("source_node_id", "relation", "target_node_id")


def dealt(frame: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``frame`` dealt by ``keys`` to tasks of about ``TASK_ROWS``, so that a task's memory doesn't follow the input; as Spark deals it where ``rows`` isn't known."""
    if rows is None:
        return frame.repartition(*keys)
    return frame.repartition(max(math.ceil(rows / TASK_ROWS), frame.sparkSession.sparkContext.defaultParallelism), *keys)


def large(frame: DataFrame) -> DataFrame:
    """``frame`` marked so that no join broadcasts it: Spark guesses its size from compressed files and doesn't count rows that lists become."""
    return frame.hint("merge")


def small(frame: DataFrame) -> DataFrame:
    """``frame`` marked for a broadcast if it has few rows, and else never broadcast."""
    return F.broadcast(frame) if frame.count() <= FEW_NODES else large(frame)


def edge_key() -> Column:
    """Edge identity is (source, relation, target)."""
    return F.concat_ws("|", "source_node_id", "relation", "target_node_id")


def edge_bindings(raw: DataFrame) -> DataFrame:
    """One row per edge and source with the strongest evidence; partial maxima before the shuffle."""
    return raw.groupBy(edge_key().alias("edge_id"), "source_node_id", "relation", "target_node_id", "source_id").agg(
        F.max("evidence_weight").alias("evidence_weight")
    )


def edge_aggregate(raw: DataFrame, rows: int | None = None) -> DataFrame:
    """``edge_id, …, weight, support_count``: edges without evidence don't appear.

    Evidence is shuffled once, by edge, without the edge's id; ``rows`` is its number where known.
    """
    bound = dealt(raw.select(*EDGE, "source_id", "evidence_weight"), rows, *EDGE).groupBy(*EDGE, "source_id").agg(F.max("evidence_weight").alias("w"))
    found = bound.groupBy(*EDGE).agg(F.max("w").alias("weight"), F.count("*").alias("support_count"))
    return found.select(edge_key().alias("edge_id"), *EDGE, "weight", "support_count")


def edge_names(raw: DataFrame, rows: int | None = None) -> DataFrame:
    """``edge_id, …`` of the edges that evidence tells, where weights and counts don't matter."""
    return dealt(raw.select(*EDGE), rows, *EDGE).distinct().select(edge_key().alias("edge_id"), *EDGE)


def node_bindings(raw: DataFrame) -> DataFrame:
    """Both ends of each piece of evidence are bound to its source."""
    ends = raw.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"), "source_id", "evidence_weight")
    return ends.groupBy("node_id", "source_id").agg(F.max("evidence_weight").alias("evidence_weight"))


def node_aggregate(bindings: DataFrame) -> DataFrame:
    """``node_id, weight, ref_count`` of nodes that have evidence."""
    return bindings.groupBy("node_id").agg(F.max("evidence_weight").alias("weight"), F.count("*").alias("ref_count"))


def upsert_bindings(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merged bindings: the larger weight, the newer content hash, the longer evidence."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(
        F.max("evidence_weight").alias("evidence_weight"),
        F.max_by("content_hash", "_new").alias("content_hash"),
        F.max_by("evidence", F.struct(F.length("evidence"), F.col("_new"))).alias("evidence"),
    )


def chunk_links(chunks: DataFrame, node_sources: DataFrame, sources: DataFrame) -> DataFrame:
    """Every chunk of a source with every node of it, where both projections are of the current content."""
    current = sources.filter(
        "graph_status = 'ready' AND rag_status = 'ready' AND graph_hash = content_hash AND rag_hash = content_hash"
    ).select("source_id")
    return chunks.join(current, "source_id", "left_semi").join(node_sources.select("source_id", "node_id"), "source_id").select("chunk_id", "node_id").distinct()


def terms(nodes: DataFrame, key) -> DataFrame:
    """``node_id, term``: the keys of a node's keyword and aliases."""
    every = F.array_union(F.array("keyword"), F.col("aliases"))
    return nodes.select("node_id", F.explode(every).alias("t")).select("node_id", key(F.col("t")).alias("term")).filter("term != ''").distinct()


def resolve_mentions(mentions: DataFrame, nodes: DataFrame, key) -> DataFrame:
    """``mention_id, node_id``: the only node that shares a term with the mention, else a new id of its key."""
    of_node = terms(nodes, key)
    of_mention = terms(mentions.withColumnRenamed("mention_id", "node_id"), key).withColumnRenamed("node_id", "mention_id")
    hits = of_mention.join(of_node, "term").groupBy("mention_id").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("hit"))
    made = F.concat(F.lit("new:"), F.substring(F.sha2(key(F.col("keyword")), 256), 1, 16))
    joined = mentions.join(hits, "mention_id", "left")
    return joined.select("mention_id", F.when(F.col("n") == 1, F.col("hit")).otherwise(made).alias("node_id"))
