"""MinHash near-duplicate detection with HyperMinHash sketches (operator 2).

1. One pass makes each text's shingle set, a signature, band keys and compressed registers.
2. Texts of equal sets form a class, represented by its smallest document; copies are never
   compared with each other.
3. Classes that share a band key share a bucket.  Every member is paired with the smallest
   one of its bucket: as many pairs as members.  The collision-corrected estimate drops
   pairs far below the threshold; the rest is decided on the full sets, which are read again
   for just these documents.
4. What the links found join already needs no more comparing.  In buckets that still hold
   several components, the pairs across components are decided too: small buckets as
   pairs, large ones in blocks, where one matrix product gives all intersections of two
   blocks exactly and only a spanning forest of the links leaves the task.  The bucket's
   largest component isn't compared within itself, so its members travel once for each block
   of the others: one outlier in a bucket of m costs m comparisons.  A pair that meets in
   several large buckets is compared in the first only.
5. Connected components of the links give each class, and so each document, its component.

Bands are chosen so that a pair at the threshold misses all of them once in ten million.
In a family of m different texts near the threshold, step 4 compares up to m * m / 2 pairs
of sets (in blocks); nothing is dropped or capped to avoid that.  Buckets are summed up by
partial aggregates and joined, so no task holds a whole one.

A set holds 64-bit hashes of its shingles; of n different shingles in all texts that are
compared, two share a hash with a probability of about n * n / 2 ** 65, and a link is wrong
only if such a pair tips it.

Defined results: a text without words, or null, has no shingles and is its own component;
rows with the same doc_id are one document; a null doc_id stays null in its component_id
unless its text is linked with others; an empty table gives no rows; other columns are not read,
so their names don't matter; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.plans.components import connected_components

from .bpe import release, slices
from .common import durable
from .sketches import band_hashes, bands_for, estimated_jaccard, shingle_set, signature, sketch

#: Registers kept for the estimate, and bits kept of each.
KEPT, KEPT_BITS = 128, 16
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5.0
#: Buckets of more members are compared in blocks.
SMALL_BUCKET = 24
#: Members, and bytes of sets, in a block.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 8 << 20
#: Bits of the filter that finds the texts to read again; fixed, so its broadcast is 2 MB at any size.
FILTER_BITS = 1 << 24


def _texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias(key), F.col("text").cast("string").alias("text"))


def sketch_documents(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, n, sig, kept, bands`` of every text; without shingles n is 0 and the rest null."""
    rows, bands = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch):
                n, sig, kept, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, k)
                    n.append(len(s))
                    if not len(s):
                        sig.append(None), kept.append(None), keys.append(None)
                        continue
                    registers = sketch(s, max(rows * bands, KEPT))
                    sig.append(signature(s))
                    kept.append((registers[:KEPT] >> np.uint32(32 - KEPT_BITS)).astype("u2").tobytes())
                    keys.append(band_hashes(registers[: rows * bands], rows).view("i8"))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(kept, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["doc_id", "n", "sig", "kept", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, sig binary, kept binary, bands array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate doesn't rule them out."""
    t = percent / 100
    least = t - SLACK * (t * (1 - t) / KEPT) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(b.num_rows, KEPT) for i in (2, 3))
                n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
                sized = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                keep = pa.array(sized & (estimated_jaccard(x, y, n, m, KEPT_BITS - 6) >= least))
                yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    side = lambda x: classes.select(F.col("node").alias(x), F.col("kept").alias(f"kept_{x}"), F.col("n").alias(f"n_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "kept_a", "kept_b", "n_a", "n_b").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``node, shingles binary`` of the documents in ``nodes``; one pass that shuffles their texts only."""
    spark = docs.sparkSession
    slot = F.xxhash64("node").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (
        nodes.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 AS int))")).alias("bits"))
    )
    table = np.zeros(FILTER_BITS // 32, "u4")
    for word, bits in words.toPandas().itertuples(index=False):
        table[word] = bits
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def wanted(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype("u4")) & 1 == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingle_set(x, k).tobytes() for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    read = _texts(docs, "node").filter(F.col("node").isNotNull()).filter(wanted(slot))
    texts = read.join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node", "text"])
    return texts.mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _check(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    likely = durable(_likely(pairs, classes, percent))
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    return durable(_verified(likely, _sets(docs, nodes, k), percent))


def links_between(x: list[np.ndarray], y: list[np.ndarray], wanted: np.ndarray, percent: int, width: int = 4096) -> np.ndarray:
    """Which wanted pairs of sets reach the threshold: intersections by products of 0/1 matrices."""
    both = np.zeros((len(x), len(y)), "f4")
    left, right = (np.concatenate(s) if s else np.zeros(0, "u8") for s in (x, y))
    words = np.intersect1d(left, right)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(words, flat)
        hit = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == flat)
        return row[hit], at[hit]

    if len(words):
        (rx, cx), (ry, cy) = places(x, left), places(y, right)
        for lo in range(0, len(words), width):
            hi = min(lo + width, len(words))
            a, b = np.zeros((len(x), hi - lo), "f4"), np.zeros((len(y), hi - lo), "f4")
            inside = (cx >= lo) & (cx < hi)
            a[rx[inside], cx[inside] - lo] = 1
            inside = (cy >= lo) & (cy < hi)
            b[ry[inside], cy[inside] - lo] = 1
            both += a @ b.T
    n = np.array([len(s) for s in x], "f8")[:, None]
    m = np.array([len(s) for s in y], "f8")[None, :]
    return wanted & (both > 0) & (100 * both.astype("f8") >= percent * (n + m - both))


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join all that the linked pairs join, as many as nodes at most."""
    out_a, out_b = [], []
    seen = np.zeros(len(b), bool)
    left_done = np.zeros(len(a), bool)
    for start in np.flatnonzero(linked.any(1)):
        stack = [start]
        while stack:
            i = stack.pop()
            if left_done[i]:
                continue
            left_done[i] = True
            new = linked[i] & ~seen
            if i == start:
                new = linked[i].copy() if not (linked[i] & seen).any() else new | (np.arange(len(b)) == np.flatnonzero(linked[i] & seen)[0])
            js = np.flatnonzero(new)
            out_a += [int(a[i])] * len(js)
            out_b += b[js].tolist()
            seen |= new
            for j in js:
                near = np.flatnonzero(linked[:, j] & ~left_done)
                if len(near):
                    out_a += a[near].tolist()
                    out_b += [int(b[j])] * len(near)
                    stack += near.tolist()
    return out_a, out_b


def _block_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in large buckets, compared block by block."""
    keys = buckets.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "bucket"))).alias("k")).select(
        "node", F.transform("k", lambda k: k["band"]).alias("bands"), F.transform("k", lambda k: k["bucket"]).alias("keys")
    )
    sizes = sets.groupBy("node").agg(F.sum(F.octet_length("shingles")).alias("bytes"))
    held = durable(buckets.select("bucket", "band", "node", "component").join(sizes, "node"))
    parts = held.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max(F.struct("n", "component", "bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(size / BLOCK_BYTES)).cast("int")
    layout = (
        parts.groupBy("bucket")
        .agg(most.alias("major"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        .select(
            "bucket",
            F.col("major.component").alias("major"),
            blocks(F.col("n") - F.col("major.n"), F.col("bytes") - F.col("major.bytes")).alias("few"),
            blocks(F.col("major.n"), F.col("major.bytes")).alias("rest"),
        )
    )
    # blocks 0 to few - 1 hold the smaller components and meet each other and all others; the rest meet only those
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    dealt = held.join(layout, "bucket").withColumn(
        "mine", F.when(F.col("component") == F.col("major"), F.col("few") + mine("rest")).otherwise(mine("few"))
    )
    last = F.when(F.col("mine") < F.col("few"), F.col("few") + F.col("rest") - 1).otherwise(F.col("few") - 1)
    met = F.transform(
        F.sequence(F.lit(0), last),
        lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")),
    )
    # few numbers a row up to here; sets are joined last and dealt once
    places = dealt.withColumn("met", F.explode(met)).select("bucket", "band", "met.i", "met.j", "mine", "node", "component")
    copies = places.join(keys, "node").join(sets, "node").select("bucket", "band", "i", "j", "mine", "node", "component", "bands", "keys", "shingles")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        band, i, j = int(group["band"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
        sides = []
        for block in (i, j):
            g = group[group["mine"] == block]
            held = np.full((len(g), 64), -1, "i8")  # its large bucket in each earlier band
            for r, (bands, keys) in enumerate(zip(g["bands"], g["keys"], strict=True)):
                held[r, bands] = keys
            sides.append((g["node"].to_numpy(), g["component"].to_numpy(), [np.frombuffer(s, "u8") for s in g["shingles"]], held))
        (a, ca, sa, ka), (b, cb, sb, kb) = sides
        wanted = ca[:, None] != cb[None, :]
        if i == j:
            wanted &= a[:, None] < b[None, :]
        for x in range(band):
            wanted &= (ka[:, None, x] != kb[None, :, x]) | (ka[:, None, x] == -1)
        rows, cols = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(rows):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        linked = links_between([sa[r] for r in rows], [sb[c] for c in cols], wanted[np.ix_(rows, cols)], percent)
        x, y = _forest(linked, a[rows], b[cols])
        return pd.DataFrame({"a": np.array(x, "i8"), "b": np.array(y, "i8")})

    return copies.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked at ``percent`` or more of Jaccard similarity."""
    sketched = durable(sketch_documents(docs, k, percent))
    classes = durable(
        sketched.filter(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("sig")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("kept").alias("kept"), F.first("bands").alias("bands"))
    )
    filed = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = filed.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("members")).filter("members > 1")
    buckets = durable(filed.join(shared, "bucket").select("band", "bucket", "node", "first", "members"))
    stars = durable(buckets.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    links = _check(stars, docs, classes, k, percent)

    found = connected_components(links).withColumnRenamed("component", "of_node")
    joined = durable(buckets.join(found, "node", "left").select("band", "bucket", "node", "members", F.coalesce("of_node", "node").alias("component")))
    mixed = joined.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most")
    split = durable(joined.join(mixed.select("bucket"), "bucket", "left_semi"))
    small = split.filter(F.col("members") <= SMALL_BUCKET)
    left = small.select("bucket", F.col("node").alias("a"), F.col("component").alias("of_a"))
    right = small.select("bucket", F.col("node").alias("b"), F.col("component").alias("of_b"))
    across = left.join(right, "bucket").filter("a < b AND of_a != of_b").select("a", "b").distinct()
    links = links.unionByName(_check(across.join(stars, ["a", "b"], "left_anti"), docs, classes, k, percent))
    large = split.filter(F.col("members") > SMALL_BUCKET)
    if not large.isEmpty():
        sets = durable(_sets(docs, large.select("node").distinct(), k))
        links = links.unionByName(durable(_block_links(large, sets, percent)))

    component = connected_components(links)
    of_class = classes.join(component, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    # texts without a set have no signature and would all meet in one task
    named = sketched.filter(F.col("sig").isNotNull()).join(of_class, "sig", "left").select("doc_id", "n", "component")
    bare = sketched.filter(F.col("sig").isNull()).select("doc_id", "n", F.lit(None).cast("long").alias("component"))
    return named.unionByName(bare).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
