"""Deduplication of graph nodes, and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import comparison_key
from quillmesh.operators.evidence import FEW_NODES, dealt, edge_key, large, small, terms
from quillmesh.operators.graph import numbered
from quillmesh.plans.components import connected_components, durable


def neighbour_signatures(edges: DataFrame, nodes: DataFrame, key=comparison_key, of: DataFrame | None = None) -> DataFrame:
    """``node_id, signature``: ``out:relation:target`` and ``in:relation:source`` by name, of all nodes or of those in ``of(node_id)``.

    ``edges`` may be raw evidence: what is told twice counts once.  A relation's key is made once, not an edge.
    """
    said = small(durable(edges.select("relation").distinct().select("relation", key(F.col("relation")).alias("said"))))
    edges = edges.join(said, "relation", "left")
    ends = None if of is None else small(durable(of.select("node_id").distinct()))
    own = lambda c: edges if ends is None else edges.join(ends.withColumnRenamed("node_id", c), c, "left_semi")
    send = F.broadcast if nodes.select("node_id").count() <= FEW_NODES else large
    name = lambda c: send(nodes.select(F.col("node_id").alias(f"{c}_node_id"), key(F.col("keyword")).alias(c)))
    out = own("source_node_id").join(name("target"), "target_node_id").select(F.col("source_node_id").alias("node_id"), F.concat_ws(":", F.lit("out"), "said", "target").alias("signature"))
    back = own("target_node_id").join(name("source"), "source_node_id").select(F.col("target_node_id").alias("node_id"), F.concat_ws(":", F.lit("in"), "said", "source").alias("signature"))
    return out.unionByName(back).distinct()


def neighbour_jaccard(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """``a, b, jaccard`` of the pairs' signature sets, 0 where one is empty."""
    side = lambda x: F.struct(F.col(x).alias("node_id"), F.lit(1 if x == "a" else 2).alias("side"))
    ends = pairs.select("a", "b").distinct().select("a", "b", F.explode(F.array(side("a"), side("b"))).alias("e")).select("e.node_id", "a", "b", "e.side")
    # signatures are read once: which sides of a pair have one
    held = signatures.join(small(ends), "node_id").groupBy("a", "b", "signature").agg(F.sum("side").alias("sides"))
    is_ = lambda *sides: F.count(F.when(F.col("sides").isin(*sides), 1))
    counted = held.groupBy("a", "b").agg(is_(1, 3).alias("n_a"), is_(2, 3).alias("n_b"), is_(3).alias("shared"))
    joined = pairs.join(counted, ["a", "b"], "left")
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return joined.select("a", "b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("shared") / union).otherwise(0.0).alias("jaccard"))


def exact_merges(nodes: DataFrame, key=comparison_key) -> DataFrame:
    """``a, b``: each node with the smallest node that shares a term with it; joined up, these are all exact merges.

    As many pairs as terms, where all pairs of a popular term would grow with its square.
    """
    of = terms(nodes, key)
    first = of.groupBy("term").agg(F.min("node_id").alias("a"))
    return of.join(first, "term").filter("node_id != a").select("a", F.col("node_id").alias("b")).distinct()


def exact_candidates(nodes: DataFrame, limit: int, key=comparison_key) -> DataFrame:
    """The first ``limit`` of all pairs that share a term, by names and ids, as a review list shows them."""
    of = terms(nodes, key).join(nodes.select("node_id", "keyword"), "node_id")
    left, right = of.select("term", F.col("node_id").alias("a"), F.col("keyword").alias("a_name")), of.select("term", F.col("node_id").alias("b"), F.col("keyword").alias("b_name"))
    pairs = left.join(right, "term").filter("a < b").select("a", "b", "a_name", "b_name").distinct()
    return pairs.orderBy("a_name", "b_name", "a", "b").limit(limit).withColumn("score", F.lit(1.0))


def keep_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, keep_id``: of each merge group the most referenced, heaviest, shortest-named node."""
    ranked = members.join(nodes.select("node_id", "ref_count", "weight", "keyword"), "node_id")
    order = F.struct((-F.col("ref_count")).alias("r"), (-F.col("weight")).alias("w"), F.length("keyword").alias("k"), F.col("node_id").alias("id"))
    best = ranked.groupBy("group_id").agg(F.min_by("node_id", order).alias("keep_id"))
    return members.join(best, "group_id").select("node_id", "keep_id")


def redirects(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, keep_id`` of all nodes that merge pairs (a, b) join, chains resolved."""
    groups = connected_components(pairs).select(F.col("node").alias("node_id"), F.col("component").alias("group_id"))
    return keep_nodes(groups, nodes)


def redirected(evidence: DataFrame, moves: DataFrame, rows: int | None = None) -> DataFrame:
    """Raw evidence with both ends redirected, without self-loops; few moves are broadcast, else ``rows`` pieces of evidence are dealt by their ends."""
    few = moves.count() <= FEW_NODES
    moved = evidence
    for c in ("source_node_id", "target_node_id"):
        to = moves.select(F.col("node_id").alias(c), F.col("keep_id").alias(f"{c}_kept"))
        moved = moved.join(F.broadcast(to), c, "left") if few else dealt(moved, rows, c).join(to, c, "left")
    ends = moved.select(
        F.coalesce("source_node_id_kept", "source_node_id").alias("source_node_id"), "relation",
        F.coalesce("target_node_id_kept", "target_node_id").alias("target_node_id"), "source_id", "evidence_weight",
    )
    return ends.filter("source_node_id != target_node_id")


def rewire(evidence: DataFrame, moves: DataFrame) -> DataFrame:
    """``redirected`` evidence whose duplicates keep the larger weight."""
    return redirected(evidence, moves).groupBy("source_node_id", "relation", "target_node_id", "source_id").agg(F.max("evidence_weight").alias("evidence_weight"))


def merge_names(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Kept nodes with the aliases, tags and longest summary of all that merged into them."""
    joined = nodes.join(moves, "node_id", "left").withColumn("keep_id", F.coalesce("keep_id", "node_id"))
    own = F.col("node_id") == F.col("keep_id")
    grouped = joined.groupBy("keep_id").agg(
        F.max(F.when(own, F.col("keyword"))).alias("keyword"),
        F.max_by("summary", F.struct(F.length("summary"), F.when(own, 1).otherwise(0), "node_id")).alias("summary"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append("aliases", F.col("keyword")))))).alias("terms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
    )
    return grouped.select(F.col("keep_id").alias("node_id"), "keyword", "summary", F.array_remove("terms", F.col("keyword")).alias("aliases"), "tags")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component``: connected components, single nodes included."""
    found = connected_components(edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")))
    return nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


#: Nodes of a component from which its depth is measured before all are looked at.
LOOKS = 3
#: Bits of one of Spark's bitmaps.
BITMAP = 32_768


def qualified(members: DataFrame, edges: DataFrame, looks: int = LOOKS) -> DataFrame:
    """``component, node_count``: components of three nodes or more that are three hops deep or more.

    A node that has another three hops away settles that its component is deep, one next to all others that it
    isn't.  So two hops are walked from one node of each component, one of least degree, and
    from the farthest of least degree next, a few times.  What is left open then, components whose extremal nodes
    all reach everything in two hops, is settled by the neighbourhoods of all their nodes, as bitmaps that
    are united edge by edge, without pairs of nodes.
    """
    size = members.groupBy("component").agg(F.count("*").alias("node_count")).filter("node_count >= 3")
    both = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")).filter("a != b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    inside = members.join(size, "component").select(F.col("node_id").alias("a"), "component", "node_count")
    hop = durable(both.join(inside, "a").select("component", "a", "b"))
    degree = durable(inside.join(hop.groupBy("a").agg(F.count("*").alias("degree")), "a"))
    flat = degree.filter("degree >= node_count - 1").select("component").distinct()
    open_ = durable(size.join(flat, "component", "left_anti"))
    deep = size.limit(0)
    seen = None  # nodes within one hop of a node looked from, and within two
    for _ in range(looks):
        rest = degree.join(open_.select("component"), "component", "left_semi")
        rank = F.struct("degree", "a")
        if seen is not None:
            rest = rest.join(seen.groupBy("a").agg(F.sum("away").alias("away")), "a", "left")
            rank = F.struct((-F.coalesce("away", F.lit(0))).alias("away"), "degree", "a")
        looking = durable(rest.groupBy("component").agg(F.min_by("a", rank).alias("a")))
        if looking.isEmpty():
            break
        one = hop.join(looking.select("a"), "a", "left_semi").select("component", F.col("b").alias("a"))
        two = one.join(hop.select("a", "b"), "a").select("component", F.col("b").alias("a"))
        start = looking.select("component", "a", F.lit(0).alias("away"))
        reached = start.unionByName(one.withColumn("away", F.lit(1))).unionByName(two.withColumn("away", F.lit(2)))
        reached = durable(reached.groupBy("component", "a").agg(F.min("away").alias("away")))
        counted = reached.groupBy("component").agg(F.count("*").alias("n"))
        settled = durable(open_.join(counted, "component").filter("n < node_count").select("component", "node_count"))
        deep, open_ = deep.unionByName(settled), durable(open_.join(settled, "component", "left_anti"))
        seen = reached if seen is None else seen.unionByName(reached)
    if open_.isEmpty():
        return deep
    left = degree.join(open_.select("component"), "component", "left_semi").select("component", "a", "node_count")
    place = durable(numbered(left, "component", "a"))
    to = place.select(F.col("a").alias("b"), (F.col("pos") % BITMAP).alias("bit"), F.floor(F.col("pos") / BITMAP).alias("part"))
    own = hop.select("a", "b").join(left.select("a"), "a", "left_semi").unionByName(left.select("a", F.col("a").alias("b")))
    near = durable(own.join(to, "b").groupBy("a", "part").agg(F.bitmap_construct_agg("bit").alias("bits")))
    united = own.join(near.withColumnRenamed("a", "b"), "b").groupBy("a", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    within = united.groupBy("a").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    far = left.join(within, "a").filter("n < node_count").select("component", "node_count").distinct()
    return deep.unionByName(far)


def community_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, node_count, edge_count`` with the edges inside each."""
    a = members.select(F.col("node_id").alias("source_node_id"), F.col("component").alias("component"))
    b = members.select(F.col("node_id").alias("target_node_id"), F.col("component").alias("_other"))
    inside = edges.join(a, "source_node_id").join(b, "target_node_id").filter("component = _other").groupBy("component").agg(F.count("*").alias("edge_count"))
    size = members.groupBy("component").agg(F.count("*").alias("node_count"))
    return size.join(inside, "component", "left").select("component", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


def summary_input(members: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """``component, names``: the first names of each community, what a summary is written from."""
    named = members.join(nodes.select("node_id", "keyword"), "node_id")
    rank = Window.partitionBy("component").orderBy("keyword", "node_id")
    first = named.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= most)
    return first.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "keyword"))), lambda x: x["keyword"]), ", ").alias("names"))


def cleaned(evidence: DataFrame) -> DataFrame:
    """Evidence without self-loops: nodes and edges derived from it are clean."""
    return evidence.filter("source_node_id != target_node_id").withColumn("edge_id", edge_key())
