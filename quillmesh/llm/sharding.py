"""Contiguous shards of near-equal bytes (operator 7).

Rows of a few numbers (id, size, checksum) are range-partitioned by id; every partition
sums its sizes and rows as it passes and is written to the shared folder, which fixes the
ranges.  The totals of the partitions, one row each, give every partition its global
offset; a row's place on the global byte line decides its shard by equal cuts, and its
place on the global row line minus that of the shard's first row is its slot.  Texts are
never shuffled, and only totals (one row a partition, one a shard) are broadcast.

Defined results: a null text has no bytes and checksum 0; null ids sort first; repeated
rows and equal ids keep separate slots; an empty table gives no rows.  A row belongs to
the shard in which its middle byte lies, so a shard misses its target by one row at most
at either end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

OVERHEAD = 8
SHARDS = 24


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: contiguous runs of ids with near-equal bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, rows = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column(1).to_numpy()
            ends = done + np.cumsum(size)
            place = rows + np.arange(len(size))
            columns = [*b.columns, pa.array(np.full(len(size), part, "i4")), pa.array(ends - size), pa.array(place)]
            yield pa.record_batch(columns, ["doc_id", "size", "text_crc32", "part", "before", "place"])
            if len(size):
                done, rows = int(ends[-1]), rows + len(size)

    schema = "doc_id long, size long, text_crc32 long, part int, before long, place long"
    ranged = durable(sized.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(running, schema))
    totals = ranged.groupBy("part").agg(F.max(F.col("before") + F.col("size")).alias("bytes"), F.max("place").alias("last"))
    # one row a partition: a single small task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum(F.col("last") + 1).over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    middle = F.col("before") + F.col("bytes_before") + F.col("size") / 2
    placed = ranged.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int").alias("shard"),
        (F.col("place") + F.col("rows_before")).alias("row"),
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
