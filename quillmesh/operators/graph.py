"""Graph search: node matching, bounded expansion, paths, neighbourhoods.

Expansion joins the frontier with the edges once per hop and keeps only what the next hop
needs; each hop is written to the shared folder, so plans stay short and survive lost
executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import comparison_key, norm_keys_full
from quillmesh.operators import textindex
from quillmesh.operators.evidence import small
from quillmesh.plans.components import durable

DIRECTIONS = ("forward", "backward", "both")


def match_nodes(entities: DataFrame, nodes: DataFrame, threshold: float, fuzzy: bool = True, key=comparison_key, keys=norm_keys_full) -> DataFrame:
    """``node_id, keyword, score``: best of each node over all entities, by an index of the nodes made for this search.

    Where searches are many, ``textindex.save`` keeps the index and ``match_indexed`` searches it.
    """
    terms = textindex.term_table(nodes, key, keys)
    return textindex.match_indexed(entities, terms, textindex.gram_table(terms), threshold, fuzzy, key, keys)


def adjacency(edges: DataFrame, direction: str = "both") -> DataFrame:
    """``at, near, direction, dir_rank`` and the edge's columns: each edge from one or both of its ends."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    kept = [c for c in edges.columns if c not in ("source_node_id", "target_node_id")]
    out = []
    if direction != "backward":
        out.append(edges.select(F.col("source_node_id").alias("at"), F.col("target_node_id").alias("near"), F.lit("forward").alias("direction"), F.lit(0).alias("dir_rank"), *kept))
    if direction != "forward":
        out.append(edges.select(F.col("target_node_id").alias("at"), F.col("source_node_id").alias("near"), F.lit("backward").alias("direction"), F.lit(1).alias("dir_rank"), *kept))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def neighbours(edges: DataFrame, node_id: str) -> DataFrame:
    """Of one node, forward before backward, each by edge."""
    near = adjacency(edges.filter((F.col("source_node_id") == node_id) | (F.col("target_node_id") == node_id)))
    return near.filter(F.col("at") == node_id).orderBy("dir_rank", "edge_id")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their places in the order, counted partition by partition."""
    schema = rows.withColumns({"_part": F.lit(0), "_at": F.lit(0).cast("long")}).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(range(seen, seen + b.num_rows), pa.int64())], schema=arrow(b))
            seen += b.num_rows

    def arrow(b: pa.RecordBatch) -> pa.Schema:
        return b.schema.append(pa.field("_at", pa.int64()))

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    held = durable(placed.mapInArrow(count, schema))
    sizes = sorted(held.groupBy("_part").count().collect())  # a row a partition
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, n) in enumerate(sizes)]
    starts = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    return held.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_before") + F.col("_at")).select(*rows.columns, "pos")


def expand(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both", most_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from ``start(node_id, ord)``.

    Returns ``node_id, depth, direction, parent, edge_id, pos`` of the nodes reached (first discovery by
    frontier order, direction, edge; a parent is one hop nearer, ``pos`` the place among the nodes of its
    depth) and ``edge_id, hop, ord`` of all edges touched, those between visited nodes included.

    A hop writes what it finds: a row an edge it touches and a row a node it reaches.  Places are
    numbers given partition by partition, so frontiers of any size are ordered without gathering them in
    one task, and what leads to a node is told by its parents alone (see ``paths``).
    """
    if not 0 <= depth <= most_depth:
        raise ValueError(f"depth must lie in 0..{most_depth}")
    near = adjacency(durable(edges.select("edge_id", "source_node_id", "target_node_id")), direction)
    none = F.lit(None).cast("string")
    first = numbered(start.select("node_id", F.col("ord").alias("k")), "k", "node_id")
    frontier = durable(first.select("node_id", F.lit(0).alias("depth"), none.alias("direction"), none.alias("parent"), none.alias("edge_id"), "pos"))
    visited = frontier
    touched = edges.sparkSession.createDataFrame([], "edge_id string, hop int, ord long")
    for hop in range(1, depth + 1):
        here = small(frontier.select(F.col("node_id").alias("at"), "pos"))
        found = durable(near.join(here, "at").select("at", "near", "edge_id", (2 * F.col("pos") + F.col("dir_rank")).alias("ord")))
        touched = touched.unionByName(found.groupBy("edge_id").agg(F.min("ord").alias("ord")).withColumn("hop", F.lit(hop)))
        new = found.join(visited.select(F.col("node_id").alias("near")), "near", "left_anti")
        new = new.groupBy("near").agg(F.min(F.struct("ord", "edge_id", "at")).alias("f")).select(F.col("near").alias("node_id"), "f.ord", F.col("f.at").alias("parent"), "f.edge_id")
        told = numbered(new, "ord", "edge_id")
        way = F.when(F.col("ord") % 2 == 0, "forward").otherwise("backward")
        frontier = durable(told.select("node_id", F.lit(hop).alias("depth"), way.alias("direction"), "parent", "edge_id", "pos"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    first_hop = touched.groupBy("edge_id").agg(F.min(F.struct("hop", "ord")).alias("m")).select("edge_id", "m.hop", "m.ord")
    return visited, first_hop


def distances(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both", most_depth: int = 10) -> DataFrame:
    """``node_id, depth`` of the nodes within ``depth`` hops of ``start(node_id)``: ``expand`` where ways don't matter.

    ``edges`` may be raw evidence, which is read anew each hop and never written; frontiers of few nodes are
    broadcast, larger ones shuffle the two ends of what is told.
    """
    if not 0 <= depth <= most_depth:
        raise ValueError(f"depth must lie in 0..{most_depth}")
    near = adjacency(edges.select("source_node_id", "target_node_id"), direction).select("at", "near")
    frontier = durable(start.select("node_id", F.lit(0).alias("depth")).distinct())
    visited = frontier
    for hop in range(1, depth + 1):
        here = small(frontier.select(F.col("node_id").alias("at")))
        new = near.join(here, "at", "left_semi").select(F.col("near").alias("node_id")).distinct()
        frontier = durable(new.join(visited, "node_id", "left_anti").select("node_id", F.lit(hop).alias("depth")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def traces(visited: DataFrame, most: int) -> DataFrame:
    """``node, depth, pos, trace`` of the first ``most`` nodes two hops away or more: steps from the start, followed back by parents."""
    step = lambda: F.struct(F.col("parent").alias("from"), "edge_id", "direction", F.col("node_id").alias("to"))
    ends = visited.filter("depth >= 2").orderBy("depth", "pos").limit(most)
    some = durable(ends.select(F.col("node_id").alias("node"), "depth", F.col("pos").alias("ord"), (F.col("depth") - 1).alias("back"), F.col("parent").alias("at"), F.array(step()).alias("trace")))
    deepest = some.agg(F.max("back")).first()[0] or 0
    for level in range(deepest, 0, -1):
        up = visited.filter(F.col("depth") == level).select(F.lit(level).alias("back"), F.col("node_id").alias("at"), F.col("parent").alias("next"), step().alias("s"))
        # ``most`` rows at most
        joined = up.join(F.broadcast(some.filter(F.col("back") == level)), ["back", "at"])
        moved = joined.select("node", "depth", "ord", (F.col("back") - 1).alias("back"), F.col("next").alias("at"), F.concat(F.array("s"), "trace").alias("trace"))
        some = durable(some.filter(F.col("back") < level).unionByName(moved))
    return some.select("node", "depth", "ord", "trace")


def paths(visited: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """``path, weight, edge_ids``: ways of two or more steps as text; all-backward ones read forward.

    Ways are followed back for the first nodes only: for twice ``limit``, as a way can be told from both its ends,
    and for more where nodes without a name leave too few.
    """
    most, every = 2 * limit, visited.filter("depth >= 2").count()
    while True:
        shown = durable(_told(traces(visited, most), edges, nodes))
        if most >= every or shown.count() >= limit:
            return shown.orderBy("depth", "ord").limit(limit).select("path", "weight", "edge_ids")
        most *= 4


def _told(ways: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    backward = F.forall("trace", lambda s: s["direction"] == "backward")
    turned = F.transform(
        F.reverse("trace"),
        lambda s: F.struct(s["to"].alias("from"), s["edge_id"].alias("edge_id"), F.lit("forward").alias("direction"), s["from"].alias("to")),
    )
    read = ways.select("node", "depth", "ord", F.when(backward, turned).otherwise(F.col("trace")).alias("trace"))
    steps = read.select("node", "depth", "ord", F.size("trace").alias("n"), F.posexplode("trace").alias("i", "s"))
    name = lambda c: nodes.select(F.col("node_id").alias(c), F.col("keyword").alias(f"{c}_name"))
    full = (
        steps.select("node", "depth", "ord", "n", "i", F.col("s.edge_id").alias("edge_id"), F.col("s.direction").alias("direction"), F.col("s.from").alias("a"), F.col("s.to").alias("b"))
        .join(edges.select("edge_id", "relation", "weight"), "edge_id")
        .join(name("a"), "a")
        .join(name("b"), "b")
    )
    text = F.when(F.col("direction") == "forward", F.concat(F.lit("->["), "relation", F.lit("]->"))).otherwise(F.concat(F.lit("<-["), "relation", F.lit("]<-")))
    part = F.struct("i", F.concat(F.when(F.col("i") == 0, F.col("a_name")).otherwise(""), text, "b_name").alias("t"), "edge_id")
    told = full.groupBy("node", "depth", "ord", "n").agg(F.array_sort(F.collect_list(part)).alias("p"), F.min("weight").alias("weight"))
    shown = told.filter(F.size("p") == F.col("n")).select(
        F.array_join(F.transform("p", lambda x: x["t"]), "").alias("path"), "weight", F.transform("p", lambda x: x["edge_id"]).alias("edge_ids"), "depth", "ord"
    )
    first = Window.partitionBy("edge_ids").orderBy("depth", "ord")
    return shown.withColumn("_r", F.row_number().over(first)).filter("_r = 1")


def relation_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_id, text``: source, relation and target by name."""
    name = lambda c: nodes.select(F.col("node_id").alias(f"{c}_node_id"), F.col("keyword").alias(c))
    joined = edges.join(name("source"), "source_node_id").join(name("target"), "target_node_id")
    return joined.select("edge_id", F.concat("source", F.lit("->["), "relation", F.lit("]->"), "target").alias("text"))


def relation_detail(edges: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge by name with its weights, a row a source that tells it; ``evidence`` has a row an edge and source."""
    key = ["source_node_id", "relation", "target_node_id"]
    name = lambda c: nodes.select(F.col("node_id").alias(f"{c}_node_id"), F.col("keyword").alias(c))
    told = edges.join(evidence.select(*key, "source_id", "evidence_weight"), key).join(name("source"), "source_node_id").join(name("target"), "target_node_id")
    return told.select("edge_id", "source", "relation", "target", "weight", "support_count", "source_id", "evidence_weight")


def groups_of(members: DataFrame, node_ids: DataFrame) -> DataFrame:
    return members.join(node_ids.select("node_id"), "node_id", "left_semi").select("group_id").distinct()


def neighbourhood(edges: DataFrame, node_id: str, depth: int, direction: str = "both", node_limit: int = 100, edge_limit: int = 500) -> tuple[DataFrame, DataFrame, bool, bool]:
    """Nodes by (depth, id) and the edges among them by id, both cut at their limits, with flags for the cuts."""
    if depth > 10 or node_limit > 10_000 or edge_limit > 50_000:
        raise ValueError("limits are 10 hops, 10,000 nodes and 50,000 edges")
    start = edges.sparkSession.createDataFrame([(node_id, 1)], "node_id string, ord long")
    near = adjacency(edges.select("edge_id", "source_node_id", "target_node_id"), direction).select("at", "near")
    visited = durable(start.select("node_id", F.lit(0).alias("depth")))
    frontier = visited
    for hop in range(1, depth + 1):
        new = near.join(frontier.select(F.col("node_id").alias("at")), "at").select(F.col("near").alias("node_id")).distinct()
        frontier = durable(new.join(visited, "node_id", "left_anti").select("node_id", F.lit(hop).alias("depth")).orderBy("node_id").limit(node_limit + 1))
        visited = durable(visited.unionByName(frontier))
        if frontier.isEmpty() or visited.count() > node_limit:
            break
    nodes = visited.orderBy("depth", "node_id").limit(node_limit)
    cut = visited.count() > node_limit
    inside = nodes.select("node_id")
    induced = edges.join(inside.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi").join(
        inside.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi"
    )
    edges_cut = induced.limit(edge_limit + 1).count() > edge_limit
    return nodes, induced.orderBy("edge_id").limit(edge_limit), cut, edges_cut


def search_entities(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Nodes by name: equal, then containing, then by alias; stronger ones first."""
    q = text.lower()
    name = F.lower("keyword")
    by_alias = F.exists("aliases", lambda a: F.lower(a).contains(q))
    kind = F.when(name == q, 0).when(name.contains(q), 1).when(by_alias, 2)
    return nodes.withColumn("class", kind).filter("class IS NOT NULL").orderBy("class", F.desc("ref_count"), "keyword", "node_id").limit(min(max(limit, 1), 100))


def readable_paths(edges: DataFrame, anchor: str, limit: int = 20) -> DataFrame:
    """Direct edges of the anchor, then chains of two edges over three nodes with the anchor among them."""
    direct = edges.filter((F.col("source_node_id") == anchor) | (F.col("target_node_id") == anchor)).select(
        F.lit(1).alias("hops"), F.array("edge_id").alias("edge_ids"), F.array("source_node_id", "target_node_id").alias("nodes")
    )
    a = edges.select(F.col("edge_id").alias("e1"), F.col("source_node_id").alias("n1"), F.col("target_node_id").alias("n2"))
    b = edges.select(F.col("edge_id").alias("e2"), F.col("source_node_id").alias("n2"), F.col("target_node_id").alias("n3"))
    at = F.lit(anchor)
    # the anchor is pushed below the join: first, middle or last
    parts = [a.filter(F.col("n1") == at).join(b, "n2"), a.filter(F.col("n2") == at).join(b.filter(F.col("n2") == at), "n2"), a.join(b.filter(F.col("n3") == at), "n2")]
    chains = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("n1 != n2 AND n2 != n3 AND n1 != n3").distinct()
    two = chains.select(F.lit(2).alias("hops"), F.array("e1", "e2").alias("edge_ids"), F.array("n1", "n2", "n3").alias("nodes"))
    return direct.unionByName(two).orderBy("hops", "edge_ids").limit(limit)


def filter_graph(
    nodes: DataFrame, edges: DataFrame, *, tag: str | None = None, min_weight: float = 0.0, min_refs: int = 0,
    min_edge_weight: float = 0.0, relation: str | None = None, group: DataFrame | None = None, source: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Visible nodes, and edges whose two ends are visible."""
    seen = nodes.filter((F.col("weight") >= min_weight) & (F.col("ref_count") >= min_refs))
    if tag is not None:
        seen = seen.filter(F.array_contains("tags", tag))
    for members in (group, source):
        if members is not None:
            seen = seen.join(members.select("node_id"), "node_id", "left_semi")
    kept = edges.filter(F.col("weight") >= min_edge_weight)
    if relation is not None:
        kept = kept.filter(F.col("relation") == relation)
    ends = seen.select("node_id")
    kept = kept.join(ends.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
    return seen, kept.join(ends.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi")


def highlighted(nodes: DataFrame, text: str) -> Column:
    """Whether a node shows the text in its name, summary, aliases or tags."""
    q = text.lower()
    listed = lambda c: F.exists(c, lambda x: F.lower(x).contains(q))
    return F.lower("keyword").contains(q) | F.lower("summary").contains(q) | listed("aliases") | listed("tags")
