"""Hard negatives for contrastive training by norm-bucketed search (operator 13).

Vectors are brought to whole numbers, so that inner products are exact.  Candidates are sorted by
norm and cut into buckets.  By Cauchy and Schwarz no row of a bucket scores more with an anchor than
the anchor's norm times the bucket's largest; a bucket that can reach neither the lower limit of one
of the anchor's windows nor the score of its k-th best row so far is skipped.

Two searches run one after the other.  Positives: rows of the anchor's label, whose buckets are
sorted by label first, so an anchor only asks those of its own.  Negatives: rows of other labels with
a score in a window below that of a positive; an anchor brings the windows of all its positives.
In each, an anchor first meets the bucket of the largest norms that it may ask; the k-th scores found
there are where the running ones begin, and choose the buckets that it is sent to next.
Within a bucket smaller steps are pruned in the same way while the running scores rise.

Buckets are ranges of Spark's range partitioning by norm and id, BUCKETS at most, so that vectors
that a third of the rows repeat are spread too; their bounds, a row each, are what is broadcast.
Rows of a bucket are dealt into blocks by its count, anchors likewise, and each block of anchors
meets each block of rows; only the k best of a window leave a block.  Where all norms are alike no
bucket can be skipped, and each anchor meets each row, in matrix products.

Defined results: rows whose label, vector or ``vec_id`` is null, or that hold null or non-finite
components, take no part, nor do rows of another length than the most common (the shorter of
equals), nor those whose squared whole components sum to 2 ** 62 or more, as a long can't hold their
scores; of rows of one ``vec_id`` the one with the smallest label, then vector, is used; zero vectors
take part, with scores of 0; an anchor without another row of its label, or a positive without rows
in its window, gives no rows; an empty table gives none; columns other than the three named aren't
read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .neighbours import packed

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these parts of a hundred of the positive's.
LOWEST, HIGHEST = 30, 90
BUCKETS = 4096
#: Rows of a bucket, and of a block, unless vectors are long; anchors of a block.
BLOCK, ANCHOR_BLOCK = 8192, 8192
BLOCK_BYTES = 16 << 20
#: Scores of a step within a block, and its rows at least.
MATRIX, STEP = 1 << 20, 64
TOO_LARGE = 1 << 62
#: Products up to here are whole in floating point, whatever the order of their sums.
_EXACT = float(1 << 53)
_NONE = int(np.iinfo("i8").min)
_ROWS = "vec_id long, label long, x binary, norm double"


@dataclass
class Asking:
    """Anchors of a block: ids, labels, vectors, norms, and of each window its limits and running k-th score."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kth: np.ndarray

    @property
    def floor(self) -> np.ndarray:
        return np.maximum(self.low, self.kth)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), "i8")


def reaches(reach: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a product of norms may come to a score, given the rounding of the norms."""
    return reach * (1 + 1e-9) + 1 >= floor


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest allowed scores of each row, of equal ones the leftmost: rows and columns."""
    few = allowed.sum(1) <= k
    if not few.all():
        rows = np.flatnonzero(~few)
        held = np.where(allowed[rows], scores[rows], _NONE)
        kth = np.partition(held, -k, 1)[:, -k][:, None]
        over, at = held > kth, allowed[rows] & (held == kth)
        allowed = allowed.copy()
        allowed[rows] = over | at & (np.cumsum(at, 1) <= k - over.sum(1)[:, None])
    return np.nonzero(allowed)


def search_block(ask: Asking, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norms: np.ndarray, k: int, same: bool, step: int | None = None) -> tuple[np.ndarray, ...]:
    """Anchor numbers, window numbers, ids and scores of the k best rows in each window."""
    a_count, windows = ask.low.shape
    best = np.repeat(ask.kth[:, :, None], k, 2)  # running scores; the k-th is the smallest
    order = np.lexsort((ids, -norms))
    found: list[tuple[np.ndarray, ...]] = []
    exact = ask.norms.max(initial=0) * norms.max(initial=0) < _EXACT
    kind = "f8" if exact else "i8"
    anchors = ask.x.astype(kind)
    step = step or max(STEP, MATRIX // max(1, a_count))
    for begin in range(0, len(order), step):
        some = order[begin : begin + step]
        some = some[np.argsort(ids[some])]  # of equal scores the smaller id is left
        reach = ask.norms * norms[some].max()
        running = np.maximum(ask.low, best.min(2))
        asks = np.flatnonzero(reaches(reach[:, None], running).any(1))
        if not len(asks):
            continue
        scores = anchors[asks] @ x[some].astype(kind).T
        scores = np.rint(scores).astype("i8") if exact else scores
        fit = (ask.labels[asks, None] == labels[None, some]) == same
        fit &= ask.ids[asks, None] != ids[None, some]
        for w in range(windows):
            floor = np.maximum(ask.low[asks, w], best[asks, w].min(1))
            i, j = best_of(scores, fit & (scores >= floor[:, None]) & (scores <= ask.high[asks, w, None]), k)
            if len(i):
                s = scores[i, j]
                found.append((asks[i], np.full(len(i), w), ids[some[j]], s))
                # a row's new scores, k at most, beside its running ones
                new = np.full((len(asks), 2 * k), _NONE)
                new[:, :k] = best[asks, w]
                new[i, k + np.arange(len(i)) - np.searchsorted(i, i)] = s
                best[asks, w] = np.sort(new, 1)[:, k:]
    if not found:
        return tuple(np.zeros(0, "i8") for _ in range(4))
    a, w, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    key = a * windows + w
    order = np.lexsort((i, -s, key))
    key, a, w, i, s = (c[order] for c in (key, a, w, i, s))
    kept = np.arange(len(key)) - np.searchsorted(key, key) < k
    return a[kept], w[kept], i[kept], s[kept]


def whole_vectors(vectors: DataFrame, label: Column, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, label, x, norm`` of the rows that take part, and their length; ``x`` holds 32-bit numbers."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(finite)
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                x = np.floor(scale * np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), "f8").reshape(b.num_rows, d))
                square = np.einsum("ij,ij->i", x, x)
            good = np.flatnonzero(square < TOO_LARGE)
            yield pa.record_batch([b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good)), packed(x[good].astype("<i4")), pa.array(np.sqrt(square[good]))], ["vec_id", "label", "x", "norm"])

    single = rows.filter(F.size("embedding") == d).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return single.select("vec_id", "r.label", "r.embedding").mapInArrow(quantise, _ROWS), d


def search(rows: DataFrame, anchors: DataFrame, n: int, d: int, k: int, same: bool, block: int | None = None, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """``anchor_id, slot, vec_id, score``: in each window of each anchor the k best rows of its label, or of others.

    ``anchors`` has ``vec_id, label, x, norm`` and arrays ``low, high`` of equal length, a window each.
    """
    size = block or max(64, min(BLOCK, BLOCK_BYTES // (8 * max(d, 1))))
    sort = ["label", F.desc("norm"), "vec_id"] if same else [F.desc("norm"), "vec_id"]
    buckets = max(1, min(BUCKETS, -(-n // size)))
    filed = durable(rows.repartitionByRange(buckets, *sort).withColumn("bucket", F.spark_partition_id()))
    bounds = durable(filed.groupBy("bucket").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.max("norm").alias("longest"), F.ceil(F.count("*") / size).cast("int").alias("blocks")))
    known = bounds.orderBy("bucket").collect()  # BUCKETS rows at most
    longest = np.array([r["longest"] for r in known], "f8")
    numbers, first_label, last_label = (np.array([r[c] for r in known], "i8") for c in ("bucket", "first", "last"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets that hold rows of a fit label and may come to one of the floors; those met before are left out."""
        for b in batches:
            label, norm = b.column("label").to_numpy(), b.column("norm").to_numpy()
            floor = np.maximum(_matrix(b.column("low")), _matrix(b.column("kth")))
            out = []
            for i in range(b.num_rows):
                inside = (first_label <= label[i]) & (label[i] <= last_label) if same else (first_label != label[i]) | (last_label != label[i])
                met = b.column("met")[i].as_py()
                out.append(numbers[inside & (numbers != (-1 if met is None else met)) & reaches(norm[i] * longest, floor[i].min(initial=np.iinfo("i8").max))].tolist())
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "buckets"])

    def ask(some: DataFrame) -> DataFrame:
        return durable(some.mapInArrow(choose, f"{_ROWS}, low array<long>, high array<long>, kth array<long>, met int, buckets array<int>").drop("met"))

    def meet(asked: DataFrame) -> DataFrame:
        posed = asked.withColumn("bucket", F.explode("buckets")).drop("buckets")
        layout = posed.groupBy("bucket").agg(F.ceil(F.count("*") / anchor_block).cast("int").alias("anchor_blocks")).join(F.broadcast(bounds.select("bucket", "blocks")), "bucket")
        layout = F.broadcast(layout)  # BUCKETS rows at most
        part = lambda m: F.pmod(F.xxhash64("vec_id"), F.col(m)).cast("int")
        each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        left = filed.join(layout, "bucket").select("bucket", part("blocks").alias("block"), each("anchor_blocks").alias("anchor_block"), "vec_id", "label", "x", "norm")
        right = posed.join(layout, "bucket").select("bucket", each("blocks").alias("block"), part("anchor_blocks").alias("anchor_block"), "vec_id", "label", "x", "norm", "low", "high", "kth")
        names = ["anchor_id", "slot", "vec_id", "score"]

        def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
            if not rows.num_rows or not asks.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=names)
            matrix = lambda t: np.frombuffer(b"".join(t["x"].to_pylist()), "<i4").reshape(t.num_rows, d)
            limits = [_matrix(asks[c].combine_chunks()) for c in ("low", "high", "kth")]
            ask = Asking(asks["vec_id"].to_numpy(), asks["label"].to_numpy(), matrix(asks), asks["norm"].to_numpy(), *limits)
            a, w, i, s = search_block(ask, rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows), rows["norm"].to_numpy(), k, same)
            return pa.table([pa.array(ask.ids[a], pa.int64()), pa.array(w, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=names)

        keys = ["bucket", "block", "anchor_block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "anchor_id long, slot int, vec_id long, score long")

    def ranked(met: DataFrame) -> DataFrame:
        order = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
        return met.withColumn("rank", order).filter(F.col("rank") <= k)

    columns = ["vec_id", "label", "x", "norm", "low", "high"]
    none = F.transform("low", lambda _: F.lit(_NONE))
    opening = ask(anchors.select(*columns, none.alias("kth"), F.lit(None).cast("int").alias("met")))
    led = durable(ranked(meet(opening.withColumn("buckets", F.slice("buckets", 1, 1)))).drop("rank"))
    kth = led.groupBy("anchor_id", "slot").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    kth = kth.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("found"))
    running = F.transform("low", lambda _, i: F.coalesce(F.col("found")[i], F.lit(_NONE)))
    told = opening.filter(F.size("buckets") > 1).join(kth, "vec_id", "left")
    rest = ask(told.select(*columns, running.alias("kth"), F.col("buckets")[0].alias("met")))
    return ranked(led.unionByName(meet(rest)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, block: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` says a row's label.
    """
    held, d = whole_vectors(vectors, label)
    held = durable(held)
    n = held.count()
    anchors = held.filter(F.coalesce(is_anchor, F.lit(False)))
    wide = anchors.withColumns({"low": F.array(F.lit(_NONE)), "high": F.array(F.lit(int(np.iinfo("i8").max)))})
    near = durable(search(held, wide, n, d, positives, True, block).select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # windows in whole numbers: lowest * p <= 100 * score <= highest * p
    hundreds, rest = F.expr("(positive_score - pmod(positive_score, 100L)) div 100L"), F.expr("pmod(positive_score, 100L)")
    low = hundreds * lowest + F.ceil(rest * lowest / 100)
    high = hundreds * highest + F.floor(rest * highest / 100)
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    # an anchor with fewer positives has windows that nothing fits
    filled = lambda c, rest: F.concat(f"w.{c}", F.array_repeat(F.lit(rest), F.lit(positives) - F.size("w")))
    asking = anchors.join(windows, "vec_id").select("vec_id", "label", "x", "norm", filled("low", int(np.iinfo("i8").max)).alias("low"), filled("high", _NONE).alias("high"))
    found = search(held, asking, n, d, negatives, False, block)
    told = found.select("anchor_id", (F.col("slot") + 1).alias("window"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return told.join(near.withColumnRenamed("rank", "window"), ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
