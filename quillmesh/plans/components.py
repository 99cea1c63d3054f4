"""Connected components of an undirected edge list, as DataFrames."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or set on the context, which driver and executors share.

    Only in local mode (tests, a laptop) it may be one of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "quillmesh-checkpoints")
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files, and checkpoints where it is set to, that nothing refers to any more.

    It does so when the driver's garbage is collected, which long jobs with a large heap would wait for while disks fill.
    """
    for _ in range(2):  # what Python lets go of is garbage to the driver only then
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: each node of ``edges(a, b)`` with the smallest node reachable.

    Alternating large-star and small-star contraction: a node hands its neighbours the
    smallest of them, so chains halve and stars stay; rounds grow with the logarithm of the
    number of nodes.  Each round shuffles edges once by node, with map-side minima, and rounds
    go on until every node has one parent that has none.  Edges with a null end are ignored;
    self-loops keep their node.
    """
    ends = edges.select(F.col("a"), F.col("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    stars = durable(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(stars):
        # large star: every larger neighbour of u joins the smallest node around u
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        alone = both.filter(F.col("u") == F.col("v"))
        large = large.unionByName(alone).distinct()
        # small star: u and its smaller neighbours join the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low, "u")
        small = joined.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        stars = durable(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
    found = stars.filter(F.col("u") != F.col("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node")).distinct()
    return found.unionByName(roots.select("node", F.col("node").alias("component")))


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has a parent."""
    up = stars.filter(F.col("u") != F.col("v"))
    several = up.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    passing = up.join(up.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return several.unionByName(passing).isEmpty()
