"""Hierarchical multi-length packing (operator 9).

Token windows come in tiers of power-of-two lengths.  Each document is cut into full
windows of the longest tier; what is left of it is routed to the shortest tier that holds
it.  Tiers are packed from long to short: a piece opens a window of its own tier, the gap
is filled by the largest fitting pieces of shorter tiers, and the last of it by cutting a
short piece, so that a window closes exactly full and needs no padding.

Every Spark partition packs its own rows in one streaming pass: texts aren't shuffled, the
buffer is bounded in tokens, and window numbers start from the partition's number, so a
task that runs again yields a whole and valid packing of its rows.  At the end of a
partition the last few thousand tokens leave in ever smaller powers of two.

Step groups are balanced over the whole table.  The pieces are kept in the shared folder;
their tokens by partition and tier, a row each, give the tokens that lie before every
partition in its tier, and a tier is cut into groups of STEP_TOKENS by that running number.
So each tier has one group at most that is part-filled, however many partitions there are;
windows shorter than all tiers count as one tier.  Groups are numbered without gaps.

Defined results: a null text is the empty text and yields its end token alone; repeated
rows are packed like any other, also those with a null or the same doc_id; a text of any
length is cut into windows as it is; an empty table gives no windows; input columns named
like an output are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ChunkEncoder, encoder, raw, slices_of_bytes, vocabulary_path, without_cycle_search
from .common import durable

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of a step group.
STEP_TOKENS = 8 * 4096
#: Pieces wait in a buffer of so many tokens at most, and are packed when it is full.
BUFFER_TOKENS = 1_000_000
#: What a partition yields; ``tier`` is 0 for windows shorter than all, ``before`` counts the tier's tokens before the window.
PACKED = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "window int, tier int, before long, ids binary"
)
PARTITION_BITS = 40


class LibraryEncoder(ChunkEncoder):
    """Ids by the model of the tokenizers library, asked once for each piece while it is cached."""

    def piece_ids(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else "".join([self.symbols[b] for b in piece.encode()])
        return raw([x.id for x in self.library.model.tokenize(shown)])


def library(path: str) -> LibraryEncoder:
    return encoder(LibraryEncoder, path)


class Packer:
    """Packs the pieces of one partition; ``windows`` collects rows of PACKED."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = BUFFER_TOKENS):
        self.tiers = tuple(sorted(tiers))
        self.longest = self.tiers[-1]
        self.buffer_tokens = buffer_tokens
        self.base = partition << PARTITION_BITS
        self.sequence = 0
        self.before: dict[int, int] = {}  # tier -> tokens in its windows so far
        self.pieces: list[tuple[int, int, int]] = []  # (length, key into self.docs, start), sorted
        self.docs: dict[int, tuple] = {}  # key -> (doc_id, ids, doc_tokens)
        self.waiting = 0
        self.key = 0
        self.windows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs[self.key] = (doc_id, ids, n)
        full = n - n % self.longest
        for start in range(0, full, self.longest):
            self._close([(self.longest, self.key, start)], self.longest)
        if full < n:
            insort(self.pieces, (n - full, self.key, full))
            self.waiting += n - full
        else:
            del self.docs[self.key]
        self.key += 1
        if self.waiting >= self.buffer_tokens:
            self._pack()

    def finish(self) -> None:
        self._pack()
        self._tail()

    def _pack(self) -> None:
        """Close windows while shorter pieces can fill them; the rest waits on."""
        for at in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[at], self.tiers[at - 1] if at else 0
            while self.pieces and below < self.pieces[-1][0] <= tier:
                taken = [self.pieces.pop()]
                gap = tier - taken[0][0]
                # of shorter tiers; in the shortest tier any piece that is left
                top = below if below else tier
                while gap and self.pieces:
                    i = bisect_right(self.pieces, (min(gap, top), self.key + 1, 0)) - 1
                    if i >= 0:
                        taken.append(self.pieces.pop(i))
                        gap -= taken[-1][0]
                    elif self.pieces[0][0] <= top:  # every one is longer than the gap: cut the shortest
                        length, key, start = self.pieces.pop(0)
                        taken.append((gap, key, start))
                        insort(self.pieces, (length - gap, key, start + gap))
                        gap = 0
                    else:
                        break
                if gap:
                    for x in taken:
                        insort(self.pieces, x)
                    break
                self._close(taken, tier)
        self.waiting = sum(x[0] for x in self.pieces)
        if self.waiting >= self.buffer_tokens // 2:  # long pieces only: nothing is left that fills their gaps
            self._stream(self.waiting % self.longest)

    def _stream(self, keep: int) -> None:
        """Close windows of the longest tier over the pieces in a row until ``keep`` tokens are left."""
        taken: list[tuple[int, int, int]] = []
        room = self.longest
        while self.waiting > keep:
            length, key, start = self.pieces.pop()
            use = min(length, room)
            taken.append((use, key, start))
            if use < length:
                insort(self.pieces, (length - use, key, start + use))
            room -= use
            self.waiting -= use
            if not room:
                self._close(taken, self.longest)
                taken, room = [], self.longest

    def _tail(self) -> None:
        self._stream(self.waiting % self.longest)
        while self.waiting:
            window = 1 << (self.waiting.bit_length() - 1)
            taken, room = [], window
            while room:
                length, key, start = self.pieces.pop()
                use = min(length, room)
                taken.append((use, key, start))
                if use < length:
                    insort(self.pieces, (length - use, key, start + use))
                room -= use
            self.waiting -= window
            self._close(taken, window)

    def _close(self, taken: list[tuple[int, int, int]], window: int) -> None:
        """A full window: emit its pieces with the tokens that its tier has before it."""
        tier = window if window in self.tiers else 0
        before = self.before.get(tier, 0)
        sequence, offset = self.base | self.sequence, 0
        self.sequence += 1
        for length, key, start in taken:
            doc_id, ids, n = self.docs[key]
            self.windows.append((doc_id, start, length, n, sequence, offset, window, tier, before, ids[4 * start : 4 * (start + length)]))
            offset += length
        self.before[tier] = before + window

    def drain(self) -> list[tuple]:
        out, self.windows = self.windows, []
        alive = {x[1] for x in self.pieces}
        self.docs = {k: v for k, v in self.docs.items() if k in alive}
        return out


def step_groups(packed: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``packed`` with ``step_group`` in the place of ``tier, before``; read twice, so cut off by the caller."""
    partition = F.shiftright("sequence_id", PARTITION_BITS)
    # a row for each partition and tier
    totals = packed.groupBy(partition.alias("partition"), "tier").agg(F.sum("length").alias("tokens"))
    of_tier = Window.partitionBy("tier").orderBy("partition")
    earlier = totals.select("partition", "tier", (F.sum("tokens").over(of_tier) - F.col("tokens")).alias("earlier"))
    counts = totals.groupBy("tier").agg(F.ceil(F.sum("tokens") / step_tokens).alias("groups"))
    first = counts.select("tier", (F.sum("groups").over(Window.orderBy("tier")) - F.col("groups")).alias("first_group"))
    placed = earlier.join(first, "tier")
    group = F.col("first_group") + F.floor((F.col("earlier") + F.col("before")) / step_tokens)
    return (
        packed.withColumn("partition", partition)
        .join(F.broadcast(placed), ["partition", "tier"])
        .select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", group.cast("long").alias("step_group"), "ids")
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, window, step_group, ids``.

    The pieces of every document in windows of ``tiers``; ids are little-endian unsigned 32-bit integers.
    """
    path = vocabulary or vocabulary_path()
    fields = [x.split() for x in PACKED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = [x for x, _ in fields], [kinds[x] for _, x in fields]
    end = end_id.to_bytes(4, "little")

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 2000):
            columns = zip(*found[at : at + 2000], strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library(path)
        packer = Packer(TaskContext.get().partitionId(), tiers, buffer_tokens)
        for batch in batches:
            for part in slices_of_bytes(batch, 1):
                with without_cycle_search():
                    ids, n = words.encode_texts(part.column(1))
                    upto, found = np.cumsum(4 * n).tolist(), ids.astype("<u4").tobytes()
                    for doc_id, at, to in zip(part.column(0).to_pylist(), [0, *upto], upto, strict=False):
                        packer.add(doc_id, found[at:to] + end)
                if packer.windows:
                    yield from rows(packer.drain())
        packer.finish()
        yield from rows(packer.drain())

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PACKED)
    return step_groups(durable(packed), step_tokens)
