"""The relational test tables seen as a knowledge store: documents, a graph with evidence, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source a document; documents without a quality label are pending."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marked = labels.select("doc_id", "quality", "toxic")
    return docs.join(marked, "doc_id", "left").select(
        F.col("doc_id").alias("source_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("lang").alias("source_type"),
        F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "ready").otherwise("failed").alias("graph_status"),
        F.when(F.col("toxic").isNull(), "pending").when(F.col("toxic") == 0, "ready").otherwise("failed").alias("rag_status"),
        F.col("n_chars").alias("origin_size"),
    )


def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, keyword, summary, aliases, tags``."""
    none = F.expr("cast(array() AS array<string>)")

    def part(name: str, node: Column, keyword: Column, summary: Column, aliases: Column, tags: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            node.alias("node_id"), keyword.alias("keyword"), summary.alias("summary"), aliases.alias("aliases"), tags.alias("tags")
        )

    return (
        part("region", _id("region", "r_regionkey"), F.col("r_name"), F.lit("region"), none, F.array(F.lit("place")))
        .unionByName(
            part("nation", _id("nation", "n_nationkey"), F.col("n_name"), F.lit("nation"), F.array(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))), F.array(F.lit("place")))
        )
        .unionByName(part("customer", _id("customer", "c_custkey"), F.col("c_name"), F.col("c_mktsegment"), none, F.array("c_mktsegment")))
        .unionByName(
            part("supplier", _id("supplier", "s_suppkey"), F.col("s_name"), F.lit("supplier"), F.array(F.concat(F.lit("Vendor "), F.col("s_suppkey").cast("string"))), none)
        )
        .unionByName(
            part(
                "part", _id("part", "p_partkey"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 1000).cast("string")),
                F.concat_ws(" ", "p_type", "p_brand"), F.array(F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))), F.array("p_type"),
            )
        )
    )


def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_node_id, relation, target_node_id, source_id, evidence_weight``: raw evidence, several rows a key."""

    def fixed(name: str, a: Column, relation: str, b: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            a.alias("source_node_id"), F.lit(relation).alias("relation"), b.alias("target_node_id"), F.lit(-1).cast("long").alias("source_id"), F.lit(1.0).alias("evidence_weight")
        )

    supplies = table(spark, sf_dir, "lineitem").select(
        _id("supplier", "l_suppkey").alias("source_node_id"),
        F.lit("supplies").alias("relation"),
        _id("part", "l_partkey").alias("target_node_id"),
        F.col("l_orderkey").alias("source_id"),
        (1 - F.col("l_discount")).alias("evidence_weight"),
    )
    return (
        fixed("nation", _id("nation", "n_nationkey"), "in", _id("region", "n_regionkey"))
        .unionByName(fixed("customer", _id("customer", "c_custkey"), "lives_in", _id("nation", "c_nationkey")))
        .unionByName(fixed("supplier", _id("supplier", "s_suppkey"), "based_in", _id("nation", "s_nationkey")))
        .unionByName(supplies)
    )


#: The same in DuckDB, as common table expressions.
SQL_NODES = """nodes AS (
    SELECT 'region:' || r_regionkey AS node_id, r_name AS keyword, 'region' AS summary, []::VARCHAR[] AS aliases, ['place'] AS tags FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', ['N' || n_nationkey], ['place'] FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, c_name, c_mktsegment, []::VARCHAR[], [c_mktsegment] FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', ['Vendor ' || s_suppkey], []::VARCHAR[] FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, p_name || ' ' || (p_partkey % 1000), p_type || ' ' || p_brand, [p_brand || ' ' || p_partkey], [p_type] FROM part
)"""
SQL_EVIDENCE = """evidence AS (
    SELECT 'nation:' || n_nationkey AS source_node_id, 'in' AS relation, 'region:' || n_regionkey AS target_node_id, -1 AS source_id, 1.0::DOUBLE AS evidence_weight FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey, -1, 1.0 FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'based_in', 'nation:' || s_nationkey, -1, 1.0 FROM supplier
    UNION ALL SELECT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, l_orderkey, 1 - l_discount FROM lineitem
)"""
SQL_EDGES = """edges AS (
    SELECT concat_ws('|', source_node_id, relation, target_node_id) AS edge_id, source_node_id, relation, target_node_id,
           max(evidence_weight) AS weight, count(DISTINCT source_id) AS support_count
    FROM evidence GROUP BY ALL
)"""
