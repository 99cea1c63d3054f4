"""How filters interact: what each order of five filters keeps, removes and repeats (operator 12).

A pass over the Arrow buffers of the texts finds, without a Python object a text, which filters each
one fails: a table of byte classes marks blanks, capitals, symbols and the bytes that begin a code
point; prefix sums of the marks give the counts of any text as differences; word hashes are sorted
within their texts, and neighbours of equal hash are compared byte by byte, so that distinct counts
are exact.  A mask of bits per text is all that goes on, with a digest for the filter of copies.

Copies are judged by the smallest ``doc_id`` of a digest, found with map-side minima; whether a row
is that first one is then asked by digest and id together, so that a text which a third of the rows
repeat isn't gathered anywhere.  What is left is counted by part and mask, 32 counts a part, and
every order, step and share follows from those counts.

Defined results: a null text is empty, and equals an empty one; a null part is the empty string; a
row without ``doc_id`` or of a repeated one is a document of its own, but copies are told by a
*smaller* id only, so rows that share the smallest one don't fail; labels that contradict each other
count as what any of them says; ids that only ``labels`` holds play no part; an empty table gives no
rows; columns other than the three read are not looked at, so their names don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices_of_bytes
from .common import durable
from .sketches import hash_words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LEAST_WORDS = 200
#: Bytes of text scanned at a time, and of a longer text at a time.
SLICE_BYTES = 1 << 20
_BLANK, _CAPITAL, _SYMBOL, _CONTINUES = 1, 2, 4, 8
#: Null ids are dealt by this many numbers, as a join would bring them together.
SALTS = 1024


def _classes() -> np.ndarray:
    out = np.zeros(256, "u1")
    out[[0x20, *range(0x09, 0x0E)]] |= _BLANK
    out[0x41:0x5B] |= _CAPITAL
    out[list(b"#$%&*|")] |= _SYMBOL
    out[0x80:0xC0] |= _CONTINUES
    return out


CLASSES = _classes()


def _sums(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many marks lie between neighbouring edges, by prefix sums."""
    total = np.zeros(len(mask) + 1, "i8")
    np.cumsum(mask, out=total[1:])
    return np.diff(total[edges])


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items that hold SLICE_BYTES in sum, or one item that holds more."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + SLICE_BYTES, "right")))
        yield at, to
        at = to


def _repeats(data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Words of each of n texts that equal an earlier one in order of their hashes."""
    order = np.lexsort((hashes, text))
    a, b = order[:-1], order[1:]
    like = np.flatnonzero((text[a] == text[b]) & (hashes[a] == hashes[b]))
    a, b = a[like], b[like]
    same = size[a] == size[b]
    for i, j in _runs(np.where(same, size[a], 0)):
        long = np.where(same[i:j], size[a[i:j]], 0)
        at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        differs = data[np.repeat(start[a[i:j]], long) + at] != data[np.repeat(start[b[i:j]], long) + at]
        same[i:j][np.repeat(np.arange(j - i), long)[differs]] = False
    out = np.bincount(text[a], minlength=n)
    for t in np.unique(text[a[~same]]):  # words that differ share a hash: count this text's as they are
        own = np.flatnonzero(text == t)
        out[t] = len(own) - len({data[s : s + k].tobytes() for s, k in zip(start[own], size[own], strict=True)})
    return out


def scan(column: pa.Array) -> dict[str, np.ndarray]:
    """``words, distinct, capitals, symbols, points`` of each text of an Arrow column of strings."""
    n = len(column)
    kind = "i8" if pa.types.is_large_string(column.type) else "i4"
    _, ends, values = column.buffers()
    edges = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype("i8") if n else np.zeros(1, "i8")
    data = np.frombuffer(values, "u1")[edges[0] : edges[-1]] if values is not None else np.zeros(0, "u1")
    edges = edges - edges[0]
    counts = {name: np.zeros(n, "i8") for name in ("words", "capitals", "symbols", "points")}
    starts, sizes, hashes, texts = [], [], [], []
    at = 0
    while at < len(data):  # of a text longer than a slice a piece at a time, cut at a blank
        to = min(at + 2 * SLICE_BYTES, len(data))
        if to < len(data):
            gaps = np.flatnonzero(CLASSES[data[at:to]] & _BLANK)
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # a word longer than a piece
                gap = next((i + int(x[0]) for i in range(to, len(data), SLICE_BYTES) if len(x := np.flatnonzero(CLASSES[data[i : i + SLICE_BYTES]] & _BLANK))), None)
                to = len(data) if gap is None else gap + 1
        kinds = CLASSES[data[at:to]]
        inside = np.clip(edges - at, 0, to - at)
        counts["capitals"] += _sums(kinds & _CAPITAL != 0, inside)
        counts["symbols"] += _sums(kinds & _SYMBOL != 0, inside)
        counts["points"] += _sums(kinds & _CONTINUES == 0, inside)
        blank = kinds & _BLANK != 0
        # a word begins behind a blank or where its text begins, and ends before a blank or its text's end
        first, last = np.ones(to - at + 1, bool), np.ones(to - at + 1, bool)
        first[1:-1] = blank[:-1]
        last[1:-1] = blank[1:]
        first[inside[(edges >= at) & (edges < to)]] = True
        cut = inside[(edges > at) & (edges <= to)]
        last[cut] = True
        begin, end = np.flatnonzero(first[:-1] & ~blank), np.flatnonzero(last[1:] & ~blank) + 1
        owner = np.searchsorted(edges, at + begin, "right") - 1
        counts["words"] += np.bincount(owner, minlength=n)
        starts.append(at + begin), sizes.append(end - begin), texts.append(owner)
        hashes.append(hash_words(data[at:to], begin, end))
        at = to
    if not starts:
        return counts | {"distinct": counts["words"].copy()}
    repeated = _repeats(data, np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes), np.concatenate(texts), n)
    return counts | {"distinct": counts["words"] - repeated}


def failed(of: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of the first four filters: bit i is set where filter i fails."""
    return (
        (of["words"] < LEAST_WORDS) * 1
        + (100 * of["distinct"] < 50 * of["words"]) * 2
        + (100 * of["capitals"] > 3 * of["points"]) * 4
        + (of["symbols"] > 0) * 8
    ).astype("i4")


def masks(docs: DataFrame, part: Column) -> DataFrame:
    """``doc_id, part, digest, salt, mask``: what each text fails by itself; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices_of_bytes(batch, 3, SLICE_BYTES):
                own = pa.array(failed(scan(some.column(3))), pa.int32())
                salt = pa.array(np.arange(some.num_rows) % SALTS, pa.int32())
                yield pa.record_batch([*some.columns[:3], salt, own], ["doc_id", "part", "digest", "salt", "mask"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    found = rows.mapInArrow(run, "doc_id long, part string, digest binary, salt int, mask int")
    return found.withColumn("salt", F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(0))


def mask_counts(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows a part."""
    # read twice from here on, so that texts are read once: a few dozen bytes a row
    found = durable(masks(docs, part))
    firsts = found.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select("doc_id", F.lit(0).alias("salt"), "digest", F.lit(True).alias("first"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = found.join(firsts, ["doc_id", "salt", "digest"], "left").join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    count = lambda flag: F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias(flag)
    return rows.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(F.count("*").alias("n"), count("good"), count("toxic"))


def _removals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each order and step: which of the 32 masks it removes, which fail its filter but went before, which are kept."""
    mask = np.arange(1 << len(FILTERS))
    here, before, kept = [], [], []
    for order in ORDERS:
        gone = np.zeros(len(mask), bool)
        for letter in order:
            fails = mask >> FILTERS.index(letter) & 1 == 1
            here.append(fails & ~gone), before.append(fails & gone)
            gone = gone | fails
            kept.append(~gone)
    return np.array(here), np.array(before), np.array(kept)


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """``part, filter_order, step`` and seven counts: a row for each part, order of the filters and step."""
    counts = mask_counts(docs, labels, part)
    of_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    columns = ", ".join(f"{c} long" for c in _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before, kept = _removals()
        letter = np.array([FILTERS.index(x) for order in ORDERS for x in order])
        steps = len(letter)
        for batch in batches:
            for name, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = (np.zeros(1 << len(FILTERS), "i8") for _ in range(3))
                for x in seen:
                    n[x["mask"]], good[x["mask"]], toxic[x["mask"]] = x["n"], x["good"], x["toxic"]
                removed = here @ n
                shapley = np.array([removed[letter == i].sum() for i in range(len(FILTERS))])
                values = (kept @ n, removed, before @ n, n[1 << letter], here @ good, here @ toxic, shapley[letter])
                keys = [pa.array([name] * steps), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist()), pa.array(np.arange(steps) % len(FILTERS) + 1, pa.int32())]
                yield pa.record_batch([*keys, *[pa.array(v, pa.int64()) for v in values]], ["part", "filter_order", "step", *_COUNTS])

    return of_part.mapInArrow(run, f"part string, filter_order string, step int, {columns}")
