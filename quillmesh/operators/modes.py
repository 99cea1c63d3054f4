"""Composite query modes: hybrid, answer context, global, federated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import clip
from quillmesh.operators.evidence import small
from quillmesh.operators.retrieval import read_text
from quillmesh.plans.components import durable

NOT_FOUND = "No matching evidence was found in the knowledge store."


def anchored(scores: DataFrame, chunk_links: DataFrame, nodes: DataFrame, factor: float) -> DataFrame:
    """Scores of chunks that are linked with a found node, times ``factor`` (1 or more)."""
    if not factor >= 1:
        raise ValueError("the factor must be 1 or more")
    near = chunk_links.join(small(nodes.select("node_id")), "node_id", "left_semi").select("chunk_id").distinct().withColumn("_near", F.lit(True))
    boosted = scores.join(near, "chunk_id", "left")
    return boosted.withColumn("score", F.when(F.col("_near"), F.col("score") * factor).otherwise(F.col("score"))).drop("_near")


def weighted_search(hits: DataFrame, objects: DataFrame, weight: float, key: str, top_k: int) -> DataFrame:
    """Entity or community hits: scores weighted, joined with their objects, best first."""
    scored = hits.select(F.col("id").alias(key), (F.col("score") * weight).alias("score"))
    return scored.join(objects, key).orderBy(F.desc("score"), key).limit(top_k)


def key_entities(members: DataFrame, nodes: DataFrame, top_k: int = 10) -> DataFrame:
    """The most referenced, heaviest nodes of the chosen communities."""
    inside = nodes.join(members.select("node_id").distinct(), "node_id", "left_semi")
    return inside.orderBy(F.desc("ref_count"), F.desc("weight"), "keyword", "node_id").limit(top_k)


def answer_context(nodes: DataFrame, edges: DataFrame, paths: DataFrame, groups: DataFrame, passages: DataFrame, entities: DataFrame, communities: DataFrame) -> DataFrame:
    """``section, position, body``: each kind of evidence up to its cap, texts clipped."""

    def part(rows: DataFrame, section: str, order: list, body: Column, most: int, signs: int) -> DataFrame:
        first = rows.select(F.struct(*[o for o in order]).alias("o"), clip(body, signs).alias("body")).orderBy("o").limit(most)
        listed = first.agg(F.array_sort(F.collect_list(F.struct("o", "body"))).alias("l")).select(F.posexplode("l").alias("position", "e"))
        return listed.select(F.lit(section).alias("section"), F.col("position").cast("long").alias("position"), F.col("e.body").alias("body"))

    named = F.concat_ws(": ", "keyword", "summary")
    return (
        part(nodes.dropDuplicates(["node_id"]), "nodes", [F.col("node_id")], named, 30, 800)
        .unionByName(part(edges, "edges", [F.col("edge_id")], F.col("text"), 40, 800))
        .unionByName(part(paths, "paths", [F.col("path")], F.col("path"), 20, 700))
        .unionByName(part(groups, "groups", [F.col("group_id")], F.col("summary"), 8, 1200))
        .unionByName(part(passages, "passages", [-F.col("score"), F.col("chunk_id")], read_text(passages), 12, 1600))
        .unionByName(part(entities, "entities", [F.col("node_id")], named, 10, 800))
        .unionByName(part(communities, "communities", [F.col("group_id")], F.col("summary"), 6, 1200))
    )


def extractive_answer(context: DataFrame) -> str:
    """The default chat model: the first passages, or else the first nodes, as they are."""
    rows = context.filter(F.col("section").isin("passages", "nodes")).orderBy(F.desc("section"), "position").limit(3).collect()
    return "\n".join(r["body"] for r in rows) or NOT_FOUND


def answer(context: DataFrame, query: str, chat: Callable[[str, list], str] | None = None) -> str:
    """A fixed reply without evidence; a model's, or the extractive one, with it."""
    if context.isEmpty():
        return NOT_FOUND
    if chat is None:
        return extractive_answer(context)
    return chat(query, [r.asDict() for r in context.orderBy("section", "position").collect()])  # capped by section


def federated(stores: dict[str, Callable[[], DataFrame]], key: str, top_k: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Results of every store with its name and ``federated_score``; stores that fail are reported, not raised."""
    found, failed = None, {}
    for name, query in sorted(stores.items()):
        try:
            rows = query()
            score = F.coalesce(*[F.col(c) for c in ("score", "match_score") if c in rows.columns], F.lit(0.0))
            # plans fail when they run, so each store's rows are written here
            rows = durable(rows.select(F.lit(name).alias("store"), key, score.alias("federated_score")))
        except Exception as why:  # one store's failure leaves the others
            failed[name] = str(why)
            continue
        found = rows if found is None else found.unionByName(rows)
    if found is not None:
        found = found.orderBy(F.desc("federated_score"), "store", key)
        found = found.limit(top_k) if top_k else found
    return found, failed


def is_available(sources: DataFrame) -> bool:
    """Whether no live source is being processed."""
    busy = (F.col("graph_status") == "processing") | (F.col("rag_status") == "processing")
    return sources.filter((F.col("exists_status") == "active") & busy).isEmpty()
