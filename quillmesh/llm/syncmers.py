"""Document fingerprints from closed syncmers (operator 3).

A k-mer of signs is a closed syncmer if the smallest of its s-mers (by hash) stands at its
first or last place.  Whether a k-mer is one depends on its own signs only, so a text that
holds the same passage holds the same anchors in it, wherever an edit is made elsewhere.

A passage that repeats gives its anchors again; the second, third and later ones are told
apart by their number.  A fingerprint keeps, of all anchors of a whole text, the ANCHORS
with the smallest hashes, each with its place: ``hash:place`` in hexadecimal, by hash,
comma-joined.  Likeness of two fingerprints compares them within the smallest hashes
of their union, as a bottom-k sketch estimates Jaccard similarity, and counts an anchor as
shared only if it has moved by about as much as most shared anchors have (positional
matching): an insertion moves all anchors behind it alike, chance matches move at random.

Neighbours by ascending id are found with one shuffle of the texts.  Ids that exist are
taken as the bounds of ranges; a document whose id is a bound is sent to the range before
it too, and the first document of all behind the last one, so each range knows its
successor and no second pass is needed.  Their number grows with the rows, and each is a task.

Defined results: a null text is empty; a text of fewer than K signs has one anchor, its
whole; the empty text has the empty fingerprint; likeness is 1 for equal fingerprints (two
empty ones too) and 0 if one is empty.  Rows of equal ids follow each other by text; a
single document is its own next; null ids come first; an empty table gives no rows; other
columns are not read, so their names don't matter.  Rows of one id stay together, so all
rows without an id are sorted in one task, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .sketches import mix

K, S = 16, 6
ANCHORS = 48
#: Signs by which an anchor's move may differ from the usual one, beside a hundredth of the text.
DRIFT = 64
#: Rows of a range at most, about; there are as many ranges as this takes.
RANGE_ROWS = 250_000


@lru_cache(maxsize=4)
def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype="u8") * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values; runs of a power of two double up."""
    out, done = mix(values + np.uint64(0x165667B19E3779F9)), 1
    factors = _factors(8)
    step = 0
    while done < width:
        more = min(done, width - done)
        n = len(values) - done - more + 1
        out = mix(out[:n] * factors[step] + out[more : more + n])
        if more < done:  # the last runs overlap: any width is reached
            out = mix(out + np.uint64(width))
        done += more
        step += 1
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, done = values, 1
    while done < width:
        more = min(done, width - done)
        n = len(values) - done - more + 1
        out = np.minimum(out[:n], out[more : more + n])
        done += more
    return out


def signs(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of a text's code points."""
    n = len(points)
    if not n:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    if n < k:
        whole = hashlib.blake2b(points.astype("<u4").tobytes(), digest_size=8).digest()
        return np.frombuffer(whole, "<u8"), np.zeros(1, "i8")
    small = _windows(points, s)
    within = k - s + 1
    least = _least(small, within)
    edge = (small[: len(least)] == least) | (small[within - 1 :] == least)
    place = np.flatnonzero(edge)
    # the k-mer's own hash, out of those of s-mers that cover it
    total = np.zeros(len(place), "u8")
    for i in [*range(0, k - s, s), k - s]:
        total = mix(total + small[place + i])
    return total, place


def sketch_anchors(text: str | None, size: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hashes of numbered anchors, ascending, and their places."""
    hashes, place = anchors(signs(text or ""))
    order = np.argsort(hashes, kind="stable")
    run = hashes[order]
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, "i8")
    number = np.arange(len(run)) - np.repeat(begins, np.diff(np.append(begins, len(run))))
    numbered = np.where(number > 0, mix(run + number.astype("u8") * np.uint64(0x27D4EB2F165667C5)), run)
    found, first = np.unique(numbered, return_index=True)
    return found[:size], place[order[first[:size]]]


def written(hashes: np.ndarray, place: np.ndarray) -> str:
    return ",".join([f"{h:016x}:{p:x}" for h, p in zip(hashes.tolist(), place.tolist(), strict=True)])


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split(":") for x in fingerprint.split(",") if x]
    return np.array([int(h, 16) for h, _ in pairs], "u8"), np.array([int(p, 16) for _, p in pairs], "i8")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = ANCHORS) -> float:
    """Jaccard similarity of two texts' anchors as their fingerprints tell it, 0 to 1."""
    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    union = np.union1d(ha, hb)[:size]
    shared, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    inside = shared <= union[-1]
    if not inside.any():
        return 0.0
    moved = (pb[ib] - pa_[ia])[inside]
    usual = np.sort(moved)[(len(moved) - 1) // 2]
    allowed = DRIFT + max(pa_.max(), pb.max()) // 100
    return float((np.abs(moved - usual) <= allowed).sum() / len(union))


def edited(text: str, after: str) -> str:
    """The last quarter of a text replaced by as many first signs of the next, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def _rows(spool: list, out: list) -> None:
    """Results of the rows in ``spool`` but for the last, whose successor isn't known yet."""
    for (doc_id, text, own), (_, after, other) in zip(spool, spool[1:], strict=False):
        changed = edited(text, after)
        new = own if changed == text else sketch_anchors(changed)
        out.append((
            doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            written(*own), written(*new), likeness(own, new), likeness(own, other),
        ))
    del spool[:-1]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [written(*sketch_anchors(x)) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """SCHEMA for every document: its fingerprint against its edited text's and the next document's."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    if ranges is None:
        ranges = max(4 * parts, -(-picked.count() // RANGE_ROWS))
    quantiles = [i / ranges for i in range(1, ranges)]
    found = picked.agg(F.min("at").alias("first"), F.percentile_approx("at", quantiles, 10 * ranges).alias("bounds")).first()
    first, bounds = found["first"], np.array(sorted({x for x in found["bounds"] or [] if x > found["first"]}), "i8")

    @F.pandas_udf("array<int>")
    def homes(at: pd.Series) -> pd.Series:
        values = at.to_numpy()
        own = np.searchsorted(bounds, values, "right")
        begins = np.isin(values, bounds)
        out = [[r, -r] if b else [r] for r, b in zip(own.tolist(), begins.tolist(), strict=True)]
        for i in np.flatnonzero(values == first):
            out[i].append(-len(bounds) - 1)
        return pd.Series(out)

    # a negative home -r: the first of range r, sent behind the rows of range r - 1
    dealt = picked.withColumn("home", F.explode(homes("at"))).select(
        F.when(F.col("home") < 0, -F.col("home") - 1).otherwise(F.col("home")).alias("range"),
        (F.col("home") < 0).alias("guest"),
        "at",
        "doc_id",
        "text",
    )
    # a range is a partition: none holds two while another holds none
    sorted_rows = dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "guest", "at", "text")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool: list = []
        out: list = []
        current = closed = None
        for batch in batches:
            for part in slices(batch):
                columns = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
                for home, guest, doc_id, text in zip(*columns, strict=True):
                    if home != current:
                        spool, current = [], home
                    if guest and closed == home:
                        continue
                    spool.append((doc_id, text, sketch_anchors(text)))
                    _rows(spool, out)
                    closed = home if guest else closed
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []

    return sorted_rows.select("range", "guest", "at", "doc_id", "text").mapInArrow(run, SCHEMA)
