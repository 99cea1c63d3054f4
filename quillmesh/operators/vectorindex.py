"""An exact index of vectors for largest inner products: blocks of near vectors, skipped where they can't matter.

A block holds up to a few hundred vectors with their centre, their greatest distance from it (radius) and
their greatest norm.  No vector of it scores above ``q * centre + |q| * radius`` or ``|q| * norm``.  A
search scores the most promising blocks first; the k-th score that they give is a floor, and
blocks whose bound lies below it are never opened.  The bounds decide what is read, never what is found:
results are those of a scan, ties to smaller ids included.

Vectors of another length than the index's, with null or non-finite components, or without an id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import vectors as V
from quillmesh.plans.components import durable
from quillmesh.snapshots import Snapshots

#: Rows and components that a block holds at most.
BLOCK_ROWS, BLOCK_VALUES = 512, 1 << 17
#: Blocks that are cut by one task, and that meet a group of queries in one.
BLOCKS_A_TASK = 128
#: Components of centres that meet a group of queries in one task.
BOUND_VALUES = 1 << 20
#: Queries of a group.
GROUP = 1000
#: The centres of cells are fitted on so many vectors or components; they only shape the blocks.
SAMPLE_ROWS, SAMPLE_VALUES, CELLS, ROUNDS = 8192, 1 << 22, 1024, 4

Fetch = Callable[[DataFrame], DataFrame]


def block_rows(dimensions: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_VALUES // dimensions))


def _matrix(column, dimensions: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, dimensions)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _centres(rows: DataFrame, n: int, dimensions: int) -> np.ndarray:
    """Centres of cells by a few rounds of k-means over a sample chosen by hash: its size is bounded."""
    size = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dimensions))
    # as many rows as a sample takes, so the driver's share doesn't grow
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(size).select("vector").collect()
    x = np.array([r["vector"] for r in sample], "f8").reshape(-1, dimensions)
    cells = max(1, min(CELLS, n // (4 * block_rows(dimensions)), len(x)))
    centres = x[:cells].copy()
    for _ in range(ROUNDS):
        of = _distances(x, centres).argmin(1)
        for c in np.unique(of):
            centres[c] = x[of == c].mean(0)
    return centres


def to_blocks(rows: DataFrame, dimensions: int, prefix: str = "") -> DataFrame:
    """``block, rows, centre, radius, norm, ids, components`` of ``rows(id, vector)``; a repeated id is a row each time.

    Rows are sorted by their nearest and second nearest centre, their distance and id, and cut where a
    cell ends or a block is full, so a cell of any size, and equal vectors of any number, spread over tasks.
    A block's name is ``prefix``, its task and its number there.
    """
    kinds = dict(rows.dtypes)
    kind, part = kinds["id"], kinds["vector"].removeprefix("array<").removesuffix(">")
    schema = f"block string, rows long, centre array<double>, radius double, norm double, ids array<{kind}>, components array<{part}>"
    rows = rows.select("id", "vector").filter(F.col("id").isNotNull() & V.is_valid(F.col("vector"), dimensions))
    n, spark = rows.count(), rows.sparkSession
    if not n:
        return spark.createDataFrame([], schema)
    centres, most = _centres(rows, n, dimensions), block_rows(dimensions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(_matrix(batch.column("vector"), dimensions), centres)
            cell = far.argmin(1)
            near = far[np.arange(len(far)), cell]
            far[np.arange(len(far)), cell] = np.inf
            columns = [*batch.columns, pa.array(cell.astype("i4")), pa.array(far.argmin(1).astype("i4")), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "cell", "second", "near"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, count, cell = [], [], 0, None
        task, number = TaskContext.get().partitionId(), 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(held)
            x = flat.astype("f8").reshape(-1, dimensions)
            centre = x.mean(0)
            radius, norm = np.sqrt(((x - centre) ** 2).sum(1).max()), np.sqrt((x * x).sum(1).max())
            columns = {
                "block": pa.array([f"{prefix}{task}-{number}"]), "rows": pa.array([len(ids)], "int64"), "centre": pa.array([centre], pa.list_(pa.float64())),
                "radius": pa.array([radius]), "norm": pa.array([norm]), "ids": pa.array([ids], pa.list_(id_type)), "components": pa.array([flat], pa.list_(value_type)),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            id_type, value_type = batch.column("id").type, batch.column("vector").type.value_type
            names, cells = batch.column("id").to_pylist(), batch.column("cell").to_numpy()
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(cells)) + 1), len(cells)] if len(cells) else []
            at = 0
            for end in map(int, ends):
                while at < end:
                    if count and (cells[at] != cell or count == most):
                        yield block()
                        ids, held, count, number = [], [], 0, number + 1
                    cell, upto = cells[at], min(end, at + most - count)
                    ids += names[at:upto]
                    held.append(flat[at * dimensions : upto * dimensions])
                    count += upto - at
                    at = upto
        if count:
            yield block()

    by = ["cell", "second", "near", "id"]
    placed = rows.mapInArrow(place, f"id {kind}, vector array<{part}>, cell int, second int, near double")
    tasks = -(-n // (most * BLOCKS_A_TASK))
    return placed.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(cut, schema)


def _upper(q: np.ndarray, bounds: pd.DataFrame) -> np.ndarray:
    """The most that a row of each block can score for each query, rounding included."""
    centre = np.array(bounds["centre"].tolist(), "f8")
    size = np.sqrt((q * q).sum(1))[:, None]
    norm = bounds["norm"].to_numpy()[None, :]
    slack = 8 * q.shape[1] * np.finfo("f8").eps * size * norm
    return np.minimum(q @ centre.T + size * bounds["radius"].to_numpy()[None, :], size * norm) + slack


def _groups(queries: DataFrame, dimensions: int) -> tuple[DataFrame, int]:
    """Queries in groups of about a thousand, without a floor yet."""
    vector = F.col("vector").cast("array<double>")
    good = durable(queries.select("query_id", vector.alias("vector")).filter(F.col("query_id").isNotNull() & V.is_valid(vector, dimensions)))
    n = good.count()
    groups = -(-n // GROUP)
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(groups, 1))).cast("int")
    return good.withColumn("g", group).withColumn("floor", F.lit(float("-inf"))), groups


def _meet(bounds: DataFrame, asks: DataFrame, groups: int, packs: int, schema: str, work: Callable) -> DataFrame:
    """Summaries of blocks, a pack at a time, meet each group of queries."""
    pack = F.pmod(F.xxhash64("block"), F.lit(packs)).cast("int")
    left = bounds.select("block", "rows", "centre", "radius", "norm", pack.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = asks.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))

    def both(key: tuple, summaries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(summaries) or not len(asked):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        upper = _upper(np.array(asked["vector"].tolist(), "f8"), summaries)
        return work(key[0], summaries, asked, upper)

    return left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInPandas(both, schema)


def _first(bounds: DataFrame, asks: DataFrame, groups: int, packs: int, k: int) -> DataFrame:
    """``g, block``: for each query the blocks of highest bounds that hold k rows together."""
    kind = dict(asks.dtypes)["query_id"]

    def best(g: int, summaries: pd.DataFrame, asked: pd.DataFrame, upper: np.ndarray) -> pd.DataFrame:
        order = np.argsort(-upper, axis=1, kind="stable")
        rows = summaries["rows"].to_numpy()[order]
        query, place = np.nonzero(np.cumsum(rows, axis=1) - rows < k)
        block = order[query, place]
        return pd.DataFrame({"g": g, "query_id": asked["query_id"].to_numpy()[query], "block": summaries["block"].to_numpy()[block], "rows": rows[query, place], "upper": upper[query, block]})

    found = _meet(bounds, asks, groups, packs, f"g int, query_id {kind}, block string, rows long, upper double", best)
    before = Window.partitionBy("query_id").orderBy(F.desc("upper"), "block").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).filter(F.col("before") < k).select("g", "block").distinct()


def _near(bounds: DataFrame, asks: DataFrame, groups: int, packs: int) -> DataFrame:
    """``g, block, asking``: blocks that can hold a result for a query of the group, and for how many."""

    def reached(g: int, summaries: pd.DataFrame, asked: pd.DataFrame, upper: np.ndarray) -> pd.DataFrame:
        n = (upper >= asked["floor"].to_numpy()[:, None]).sum(0)
        return pd.DataFrame({"g": g, "block": summaries["block"].to_numpy()[n > 0], "asking": n[n > 0]})

    return _meet(bounds, asks, groups, packs, "g int, block string, asking long", reached)


def _scored(fetch: Fetch, near: DataFrame, asks: DataFrame, k: int, dimensions: int, blocks: int) -> DataFrame:
    """``query_id, id, score``: of each task's blocks the best k of each query, at or above its floor.

    Products of matrices choose; what is kept is summed again component by component, so that
    equal vectors have equal scores wherever they lie.
    """
    packs = -(-blocks // BLOCKS_A_TASK)
    pack = F.pmod(F.xxhash64("block"), F.lit(packs)).cast("int").alias("p")
    pairs = near.select("g", "block", pack)
    left = fetch(pairs.select("block").distinct()).select("block", "centre", "radius", "norm", "ids", "components").join(pairs, "block")
    right = asks.join(pairs.select("g", "p").distinct(), "g")
    kinds = dict(left.dtypes)["ids"].removeprefix("array<").removesuffix(">"), dict(asks.dtypes)["query_id"]
    columns = ["query_id", "id", "score"]

    def score(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({c: [] for c in columns})
        q, floor, names = np.array(asked["vector"].tolist(), "f8"), asked["floor"].to_numpy(), asked["query_id"].to_numpy()
        upper, size, best = _upper(q, held), np.sqrt((q * q).sum(1)), None
        for b, (ids, components, norm) in enumerate(zip(held["ids"], held["components"], held["norm"], strict=True)):
            asking = np.flatnonzero(upper[:, b] >= floor)
            if not len(asking):
                continue
            x = np.asarray(components, "f8").reshape(-1, dimensions)
            rough = q[asking] @ x.T
            least = floor[asking]
            if len(x) > k:
                least = np.maximum(least, -np.partition(-rough, k - 1, axis=1)[:, k - 1])
            slack = 8 * dimensions * np.finfo("f8").eps * size[asking] * norm
            query, row = np.nonzero(rough >= (least - slack)[:, None])
            exact = np.cumsum(q[asking[query]] * x[row], axis=1)[:, -1]
            found = pd.DataFrame({"query_id": names[asking[query]], "id": np.asarray(ids)[row], "score": exact})
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        return best if best is not None else pd.DataFrame({c: [] for c in columns})

    return left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInPandas(score, f"query_id {kinds[1]}, id {kinds[0]}, score double")


def _with_floors(fetch: Fetch, bounds: DataFrame, queries: DataFrame, k: int, dimensions: int) -> tuple[DataFrame, int, int, int]:
    """Queries with a floor: the k-th score in the blocks of highest bounds, none where those hold fewer rows."""
    asks, groups = _groups(queries, dimensions)
    blocks = bounds.count()
    packs = -(-blocks * dimensions // BOUND_VALUES)
    if not groups or not blocks:
        return asks, groups, packs, blocks
    first = durable(_first(bounds, asks, groups, packs, k))
    scored = _scored(fetch, first, asks, k, dimensions, blocks)
    floors = _ranked(scored, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_floor"))
    joined = asks.join(floors, "query_id", "left").withColumn("floor", F.coalesce("_floor", "floor")).select(*asks.columns)
    return durable(joined), groups, packs, blocks


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(fetch: Fetch, bounds: DataFrame, queries: DataFrame, k: int, dimensions: int, id_type: str = "bigint") -> DataFrame:
    """``query_id, id, score, rank``: the k rows of largest inner product of each query, ties to smaller ids.

    ``fetch`` gives the blocks of a table of names.  An empty index, and queries that are no vectors, find nothing.
    """
    asks, groups, packs, blocks = _with_floors(fetch, bounds, queries, k, dimensions)
    if not groups or not blocks:
        kind = dict(asks.dtypes)["query_id"]
        return bounds.sparkSession.createDataFrame([], f"query_id {kind}, id {id_type}, score double, rank int")
    near = durable(_near(bounds, asks, groups, packs))
    return _ranked(_scored(fetch, near, asks, k, dimensions, blocks), k)


def top_of_many(rows: DataFrame, queries: DataFrame, k: int, dimensions: int) -> DataFrame:
    """A search over ``rows(id, vector)`` that are made into blocks for it; ids that repeat count once each row."""
    blocks = durable(to_blocks(rows, dimensions))
    return search(lambda names: blocks.join(names, "block", "left_semi"), blocks, queries, k, dimensions, dict(rows.dtypes)["id"])


class VectorIndex(Snapshots):
    """The index as tables under a folder: what an addition or a deletion writes grows with it.

    ``bounds`` tells of every block what a search must know, ``blocks`` holds the vectors, ``places`` the block of an id.
    """

    def __init__(self, spark: SparkSession, root: str, dimensions: int, id_type: str = "bigint", component: str = "float"):
        self.dimensions, self.id_type, self.component = dimensions, id_type, component
        bounds = "block string, rows long, centre array<double>, radius double, norm double"
        schemas = {"bounds": bounds, "blocks": f"{bounds}, ids array<{id_type}>, components array<{component}>", "places": "id string, block string"}
        super().__init__(spark, root, schemas, {"bounds": ("block",), "blocks": ("block",), "places": ("id",)})

    def _rows(self, vectors: DataFrame) -> DataFrame:
        rows = vectors.select(F.col("id").cast(self.id_type).alias("id"), F.col("vector").cast(f"array<{self.component}>").alias("vector"))
        return rows.filter(F.col("id").isNotNull() & V.is_valid(F.col("vector"), self.dimensions))

    def _placed(self, blocks: DataFrame) -> DataFrame:
        return blocks.select(F.explode("ids").alias("id"), "block").select(F.col("id").cast("string").alias("id"), "block")

    def build(self, vectors: DataFrame) -> int:
        """The index of ``vectors(id, vector)`` and nothing else; repeated ids raise.  Returns its blocks' number."""
        base, rows = self.version(), durable(self._rows(vectors))
        self._unique(rows)
        blocks = durable(to_blocks(rows, self.dimensions, f"{base + 1}-"))
        self.commit({"bounds": blocks, "blocks": blocks, "places": self._placed(blocks)}, base)
        return blocks.count()

    def _unique(self, rows: DataFrame) -> None:
        if not rows.groupBy("id").count().filter("count > 1").isEmpty():
            raise ValueError("vector ids repeat")

    def _kept(self, ids: DataFrame, base: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The blocks that hold some of ``ids``, the rows of them that stay, and the places of ids that go."""
        places = durable(self.read_keys("places", ids.select(F.col("id").cast("string").alias("id")).distinct(), base))
        touched = durable(places.select("block").distinct())
        held = self.read_keys("blocks", touched, base)
        size = self.dimensions
        pieces = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.slice("components", i * size + 1, size).alias("vector")))
        rows = held.select(F.explode(pieces).alias("r")).select("r.id", "r.vector")
        gone = places.select(F.col("id").cast(self.id_type).alias("id"))
        return touched, durable(rows.join(gone, "id", "left_anti")), places

    def _change(self, new: DataFrame, gone: DataFrame) -> int:
        """Blocks that lose rows are cut anew, beside what comes; all others stay where they are."""
        base = self.version()
        touched, kept, places = self._kept(gone, base)
        blocks = durable(to_blocks(kept.unionByName(new), self.dimensions, f"{base + 1}-"))
        placed = durable(self._placed(blocks))
        erased = durable(placed.select("id").unionByName(places.select("id")).distinct())
        return self.commit({}, base, {"bounds": (blocks, touched), "blocks": (blocks, touched), "places": (placed, erased)})

    def add(self, vectors: DataFrame) -> int:
        """New vectors; ids that repeat or are there already raise.  Returns the version, as the next two do."""
        rows = durable(self._rows(vectors))
        self._unique(rows)
        ids = rows.select(F.col("id").cast("string").alias("id"))
        if not self.read_keys("places", ids).isEmpty():
            raise ValueError("vector ids are taken")
        return self._change(rows, self.spark.createDataFrame([], f"id {self.id_type}"))

    def delete(self, ids: DataFrame) -> int:
        """Without the rows of ``ids(id)``; ids that aren't there change nothing."""
        return self._change(self.spark.createDataFrame([], f"id {self.id_type}, vector array<{self.component}>"), durable(ids.select("id")))

    def replace(self, vectors: DataFrame) -> int:
        """These vectors for their ids, whether they are there or not; one that is no vector takes its id away."""
        rows = durable(self._rows(vectors))
        self._unique(rows)
        return self._change(rows, durable(vectors.select("id").filter("id IS NOT NULL")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, id, score, rank`` for ``queries(query_id, vector)``; see ``search``."""
        version = self.version()
        return search(lambda names: self.read_keys("blocks", names, version), self.read("bounds", version), queries, k, self.dimensions, self.id_type)

    def blocks_read(self, queries: DataFrame, k: int) -> float:
        """The share of all pairs of a query and a block that a search scores."""
        version = self.version()
        bounds = self.read("bounds", version)
        asks, groups, packs, blocks = _with_floors(lambda names: self.read_keys("blocks", names, version), bounds, queries, k, self.dimensions)
        if not groups or not blocks:
            return 0.0
        asked = _near(bounds, asks, groups, packs).agg(F.sum("asking")).first()[0]
        return asked / (blocks * asks.count())

    def ids(self) -> DataFrame:
        return self.read("places").select(F.col("id").cast(self.id_type).alias("id"))
