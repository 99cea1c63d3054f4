"""Synchronisation as a stream: micro-batches folded into a state whose keys are changed in place.

The state is a table of parts and deletes (see ``snapshots``): a batch reads the files that can hold its keys
and writes the rows that it changes, so its work grows with the batch and not with the state.  A version
remembers the batch it was made by, so a batch that is played again after a crash changes nothing, and
readers never see half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.changes import STATE, synchronise
from quillmesh.plans.components import durable
from quillmesh.snapshots import Snapshots

#: Versions that readers may still be at.
KEPT = 3


class SnapshotState(Snapshots):
    """Rows by ``source_uri`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: str = STATE):
        super().__init__(spark, root, {"state": schema}, {"state": ("source_uri",)})

    def last_batch(self) -> int:
        """The number of the batch that the newest version holds, -1 before the first."""
        return self.manifest().get("notes", {}).get("batch", -1)

    def read(self, name: str = "state", version: int | None = None) -> DataFrame:
        return super().read(name, version)


def fold_batch(state: SnapshotState, batch: DataFrame, number: int) -> None:
    """Fold a micro-batch: of several records of a source the newest counts, others can't win anyway."""
    if number <= state.last_batch():
        return
    newest = Window.partitionBy("source_uri").orderBy(F.desc("updated_at"), F.desc("revision"))
    one = durable(batch.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r"))
    held = durable(state.read_keys("state", one.select("source_uri")))
    after, _ = synchronise(held, one)
    changed = durable(after.select(*held.columns).subtract(held))
    state.commit({}, None, {"state": (changed, changed)}, {"batch": number})
    state.vacuum(KEPT)


def stream_sync(changes: DataFrame, state_root: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of records into the state under ``state_root``, all that is there now."""
    state = SnapshotState(changes.sparkSession, state_root)
    return (
        changes.writeStream.foreachBatch(lambda df, number: fold_batch(state, df, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
