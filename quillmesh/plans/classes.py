"""Connected components kept as a table while edges come and go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.plans.components import connected_components, durable


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))


def updated_classes(classes: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame, gone: DataFrame, born: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a change of a graph does to its components: ``changed(node, component)`` and ``dropped(node)``.

    ``classes(node, component)`` is the table so far, the component being the smallest node of it;
    ``edges(a, b)`` are the edges that stay, ``removed`` and ``added`` those that went and came;
    ``gone`` and ``born`` hold nodes, and a node that goes loses all its edges.  ``changed`` has new
    nodes and those with another component than before, so what is written grows with what has changed.

    An edge that comes joins two classes, each of which stands as its smallest node.  An edge that
    goes can only part a class if both its ends had others: a node that loses its one edge just leaves.
    Classes that may have parted, or lost the node they are named after, are worked out anew
    from their own edges.  Repeated edges are one, self-loops change nothing, edges with a null end
    are ignored.
    """
    whole = lambda e: e.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    removed, added = durable(whole(removed)), durable(whole(added))
    gone, born = durable(gone.select("node").distinct()), durable(born.select("node").distinct())
    edges = whole(edges)
    lost = durable(_ends(removed).groupBy("node").agg(F.count("*").alias("n")))
    left = _ends(edges).join(lost, "node", "left_semi").distinct()
    single = durable(lost.join(left, "node", "left_anti"))
    leaf = single.filter("n = 1").select("node")
    parting = removed.join(leaf.withColumnRenamed("node", "a"), "a", "left_anti").join(leaf.withColumnRenamed("node", "b"), "b", "left_anti")
    nameless = single.select("node").unionByName(gone).select(F.col("node").alias("component"))
    dirty = durable(
        classes.join(_ends(parting), "node", "left_semi").select("component").unionByName(classes.join(nameless, "component", "left_semi").select("component")).distinct()
    )
    loose = classes.join(dirty, "component", "left_semi").select("node").unionByName(single.select("node")).unionByName(born)
    loose = durable(loose.distinct().join(gone, "node", "left_anti"))
    # a class that stays whole stands as its smallest node, others as their nodes
    held = classes.join(loose, "node", "left_anti").join(gone, "node", "left_anti")
    ends = durable(_ends(added).distinct().join(held, "node", "left").select("node", F.coalesce("component", "node").alias("stands")))
    to = lambda c: ends.select(F.col("node").alias(c), F.col("stands").alias(f"{c}_"))
    joined = added.join(to("a"), "a").join(to("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    inner = edges.join(loose.withColumnRenamed("node", "a"), "a", "left_semi").join(loose.withColumnRenamed("node", "b"), "b", "left_semi")
    found = durable(connected_components(inner.unionByName(joined)))
    own = loose.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    renamed = found.filter("node != component").select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = held.join(renamed, F.col("component") == F.col("old")).select("node", F.col("new").alias("component"))
    before = classes.select("node", F.col("component").alias("before"))
    changed = own.unionByName(moved).join(before, "node", "left").filter("before IS NULL OR before != component").select("node", "component")
    return durable(changed), gone
