"""Approximate nearest neighbours with a forest of random-projection trees (operator 5).

Trees are grown on a bounded sample: a node parts its sample vectors at the median of their
projections on the difference of two random ones.  The forest (TREES times about
SAMPLE / LEAF leaves, fixed at any input size) is all that is broadcast.

A query walks all trees from one priority queue: the queue holds subtrees with the sum of
squares of the margins by which the query misses them, and the nearest is opened first
whatever its tree, until the leaves reached hold the query's budget of rows.  The budget is
``BUDGET * n ** POWER`` rows of n, over all trees, so its share of the table falls as the
table grows: on isotropic vectors of 64 dimensions, for which no index can do with few, the
rows needed for a recall of 0.9 grew about so.

Rows and queries then meet by leaf.  Leaves of small tables are bundled into cells, those of
large ones are cells of their own; a cell's rows and queries are dealt into blocks by their
counts, and each block of rows meets each of queries.  Matrix products pick what may be
among the best k, which is measured again in double precision on the original vectors; only
the best k of a block leave it.

Equal vectors are one class: the k + 1 smallest ids of a class are all that any query can
need of it, and equal queries are asked once.  So a vector that a third of the table
repeats costs no more than any other.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
components take no part, nor do vectors of another length than the most common (the
shorter of equals); rows of equal vec_id and vector are one row; with fewer than k candidates
all are found; without queries the result is empty; other columns are not read, so their
names don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

TREES = 12
SAMPLE = 16_384
#: The sample is smaller where vectors are so long that it would hold more bytes than this.
SAMPLE_BYTES = 32 << 20
LEAF = 16
#: Rows that a query looks at, counted in each tree: BUDGET * n ** POWER of n.
BUDGET, POWER = 4.0, 0.8
#: Rows of a cell and of a block of rows, queries of a block.
BLOCK = 16_384
QUERY_BLOCK = 8192
#: Entries of a matrix of distances at a time.
MATRIX = 1 << 21
SEED = 11


@dataclass
class Tree:
    """Inner nodes: ``normals[i]``, ``cuts[i]``, ``kids[i]``; a kid below 0 is leaf ``-kid - 1`` of ``sizes``."""

    normals: np.ndarray
    cuts: np.ndarray
    kids: np.ndarray
    sizes: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        out = np.zeros(len(x), "i4")
        if not len(self.kids):
            return out
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            right = x[rows] @ self.normals[node] > self.cuts[node]
            for kid, part in ((self.kids[node, 0], rows[~right]), (self.kids[node, 1], rows[right])):
                if not len(part):
                    continue
                if kid < 0:
                    out[part] = -kid - 1
                else:
                    waiting.append((int(kid), part))
        return out


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, cuts, kids, sizes = [], [], [], []

    def leaf_node(rows: np.ndarray) -> int:
        sizes.append(len(rows))
        return -len(sizes)

    def split(rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        for _ in range(8):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                along = sample[rows] @ normal
                cut = float(np.median(along))
                right = along > cut
                if 0 < right.sum() < len(rows):
                    return normal, cut, right
        return None  # the same vector over and over

    if len(sample) <= leaf or (first := split(np.arange(len(sample)))) is None:
        return Tree(np.zeros((0, sample.shape[1])), np.zeros(0), np.zeros((0, 2), "i4"), np.array([len(sample)]))
    waiting = [(np.arange(len(sample)), first, -1, 0)]
    while waiting:
        rows, (normal, cut, right), parent, side = waiting.pop()
        me = len(cuts)
        normals.append(normal), cuts.append(cut), kids.append([0, 0])
        if parent >= 0:
            kids[parent][side] = me
        for i, part in ((0, rows[~right]), (1, rows[right])):
            found = split(part) if len(part) > leaf else None
            if found is None:
                kids[me][i] = leaf_node(part)
            else:
                waiting.append((part, found, me, i))
    return Tree(np.array(normals), np.array(cuts), np.array(kids, "i4"), np.array(sizes))


@dataclass
class Forest:
    trees: list[Tree]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        return np.stack([t.leaf_of(x) for t in self.trees], 1)

    def probes(self, query: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """``(tree, leaf)`` by the shared priority queue until the leaves hold ``budget`` sample vectors."""
        queue: list[tuple[float, int, int]] = [(0.0, i, 0 if len(t.kids) else -1) for i, t in enumerate(self.trees)]
        along = [t.normals @ query - t.cuts for t in self.trees]
        out = []
        while queue and budget > 0:
            miss, i, node = heapq.heappop(queue)
            if node < 0:
                out.append((i, -node - 1))
                budget -= self.trees[i].sizes[-node - 1]
                continue
            margin = along[i][node]
            near, far = self.trees[i].kids[node][::-1] if margin > 0 else self.trees[i].kids[node]
            heapq.heappush(queue, (miss, i, int(near)))
            heapq.heappush(queue, (miss + margin * margin, i, int(far)))
        return out


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    ends = np.arange(len(x) + 1, dtype="i4") * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def closest(ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, q: np.ndarray, asked: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows nearest to each query among those in the leaves it asked for: query numbers, ids, distances."""
    order = np.argsort(leaf, kind="stable")
    leaves, begins = np.unique(leaf[order], return_index=True)
    ends = np.append(begins[1:], len(order))
    who = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    wish = np.concatenate(asked) if asked else np.zeros(0, "i4")
    by_leaf = np.argsort(wish, kind="stable")
    lo, hi = np.searchsorted(wish[by_leaf], leaves), np.searchsorted(wish[by_leaf], leaves, "right")
    xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    slack = 1e-9 * (xx.max(initial=0) + qq.max(initial=0))  # far more than the rounding of the products
    found_q, found_x = [], []
    for at, to, first, last in zip(begins, ends, lo, hi, strict=True):
        rows, askers = order[at:to], who[by_leaf[first:last]]
        step = max(1, MATRIX // len(rows))
        for begin in range(0, len(askers), step):
            some = askers[begin : begin + step]
            away = qq[some, None] + xx[rows] - 2 * (q[some] @ x[rows].T)
            if len(rows) > k:
                i, j = np.nonzero(away <= np.partition(away, k - 1, 1)[:, k - 1 : k] + slack)
            else:
                i, j = (y.ravel() for y in np.indices(away.shape))
            found_q.append(some[i]), found_x.append(rows[j])
    if not found_q:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    fq, fx = np.concatenate(found_q), np.concatenate(found_x)
    score = np.concatenate([np.sqrt(((x[fx[i : i + 65536]] - q[fq[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(fq), 65536)])
    best = np.lexsort((ids[fx], score, fq))
    fq, fx, score = fq[best], fx[best], score[best]
    nth = np.arange(len(fq)) - np.searchsorted(fq, fq)
    return fq[nth < k], ids[fx[nth < k]], score[nth < k]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf: int = LEAF,
    budget: float = BUDGET,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows nearest to each row with ``is_query``, but not itself."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("embedding") if single else F.col("embedding").cast("array<double>")).alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, n = (lengths["d"], lengths["count"]) if lengths else (1, 0)
    rows = rows.filter(F.size("embedding") == d)
    # at most ``sample`` vectors, by hash of the id; the hash is cut first, so few more reach the driver
    sample = max(2, min(sample, SAMPLE_BYTES // (8 * d)))
    share = min(1.0, 1.2 * sample / max(n, 1))
    mixed = F.xxhash64("vec_id")
    drawn = rows.filter(F.pmod(mixed, F.lit(1 << 30)) <= int(share * (1 << 30)))
    taken = drawn.orderBy(mixed, "vec_id").limit(sample).select("embedding").toPandas()
    points = np.array(taken["embedding"].tolist(), "f8").reshape(-1, d)
    rng = np.random.default_rng(SEED)
    forest = Forest([grow(points, leaf, rng) for _ in range(trees)])
    # the leaves' sample vectors stand for rows, n / len(points) each
    allowed = budget * max(n, 1) ** (POWER - 1) * len(points)
    leaves = max(len(t.sizes) for t in forest.trees)
    per_cell = max(1, min(64, block * leaves // max(n, 1)))
    shared = spark.sparkContext.broadcast(forest)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, d)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                own = pa.FixedSizeListArray.from_arrays(pa.array(shared.value.leaves(x).ravel()), trees)
                yield pa.record_batch([b.column(0), packed(x.astype(kind)), own.cast(pa.list_(pa.int32()))], ["vec_id", "v", "leaves"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1)) if b.num_rows else np.zeros((0, d))
            for i in range(b.num_rows):
                own = np.array(shared.value.probes(x[i], allowed), "i4").reshape(-1, 2)
                own = own[np.lexsort((own[:, 1], own[:, 0]))]
                cell = own[:, 0].astype("i8") << 32 | own[:, 1] // per_cell
                _, begins = np.unique(cell, return_index=True)
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(b.column(0)[i].as_py(), len(begins)), pa.int64()),
                        packed(np.repeat(x[i : i + 1].astype(kind), len(begins), 0)),
                        pa.array(own[begins, 0]),
                        pa.array(own[begins, 1] // per_cell),
                        pa.ListArray.from_arrays(pa.array(np.append(begins, len(own)), pa.int32()), pa.array(own[:, 1])),
                    ],
                    ["rep", "q", "tree", "cell", "asked"],
                )

    # of a class of equal vectors the smallest ids are enough: one more than k, as a query isn't its own neighbour
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    single_rows = rows.groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks"))
    held = single_rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).select("vec_id", "embedding")
    asking = rows.filter("asks").select("vec_id", "embedding").distinct()
    reps = durable(asking.groupBy("embedding").agg(F.min("vec_id").alias("rep")))
    members = asking.join(reps, "embedding").select(F.col("vec_id").alias("query_id"), "rep")

    placed = held.mapInArrow(place, "vec_id long, v binary, leaves array<int>")
    filed = placed.select("vec_id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    filed = durable(filed.withColumn("cell", F.floor(F.col("leaf") / per_cell).cast("int")))
    asked = durable(reps.select("rep", "embedding").mapInArrow(ask, "rep long, q binary, tree int, cell int, asked array<int>"))
    # a row for each cell that is asked for
    layout = F.broadcast(
        filed.groupBy("tree", "cell")
        .agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        .join(asked.groupBy("tree", "cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("query_blocks")), ["tree", "cell"])
    )
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = filed.join(layout, ["tree", "cell"]).select(
        "tree", "cell", part("vec_id", "blocks").alias("block"), each("query_blocks").alias("query_block"), "vec_id", "v", "leaf"
    )
    posed = asked.join(layout, ["tree", "cell"]).select(
        "tree", "cell", each("blocks").alias("block"), part("rep", "query_blocks").alias("query_block"), "rep", "q", "asked"
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda c: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(-1, d).astype("f8")
        names = ["rep", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        wishes = [np.asarray(a, "i4") for a in right["asked"].to_pylist()]
        reps, ids = right["rep"].to_numpy(), left["vec_id"].to_numpy()
        who, found, score = closest(ids, read(left["v"]), left["leaf"].to_numpy(), read(right["q"]), wishes, k + 1)
        return pa.table([pa.array(reps[who], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=names)

    keys = ["tree", "cell", "block", "query_block"]
    met = dealt.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInArrow(meet, "rep long, vec_id long, score double")
    # a row met in several trees has the same score in each, so it takes one place
    best = met.withColumn("place", F.dense_rank().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).filter(F.col("place") <= k + 1)
    best = best.select("rep", "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id", "rep").orderBy("score", "vec_id"))
    answers = members.join(best, "rep").filter("vec_id != query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
