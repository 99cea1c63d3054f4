"""BPE encoding and decoding (operator 1).

``BpeCodec`` re-states a public ``tokenizers`` JSON file (BPE model, byte-level
alphabet, end-of-word suffix) as plain Python.  A word is merged with a priority
queue of merge ranks over a doubly linked symbol list: the queue holds
``(rank, position)`` entries, a merge unlinks its right symbol and pushes the two
pairs that it creates, and entries whose pair has changed since are skipped when
they surface.  That is O(n log n) for a word of n bytes, so one word of a megabyte
does not stall a task.

A slice of texts is parted at blanks and into pieces by Arrow, column by column, and coded
by dictionaries: the distinct chunks of the slice, then their distinct pieces.  Python looks
at each distinct piece once a slice, in a bounded two-generation cache, and merges it on a
miss; the ids of the texts are gathered from there by offsets.  Chunks with letters beyond
Latin, or blanks other than space and line feed, are normalised and split by the library
itself, as Unicode tables differ between engines; merging is ours for every piece.

Defined results: a null text encodes as the empty text (no ids, empty decoded text);
control strings of the vocabulary found in a text become their single ids, as in the
library's default; input columns named like an output are ignored.
"""

from __future__ import annotations

import gc
import heapq
import json
import sys
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Entries in a generation of the caches of pieces and of odd chunks, per Python worker.
CACHE_PIECES, CACHE_CHUNKS = 200_000, 50_000
#: Longer ones are encoded each time they occur.
CACHE_CHARS = 40
#: Rows taken out of an Arrow batch at once.
SLICE_ROWS = 128
#: Bytes of text encoded at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Chunks that Arrow can part: Latin without blanks, and without the one letter whose lower case is two.
SIMPLE = r"^[!-~\x{a1}-\x{12f}\x{131}-\x{24f}]*$"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of a public vocabulary file; the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(0x100 + extra)
            extra += 1
    return out


class TwoGenerations:
    """Two dictionaries: when the young one is full, it takes the place of the old one."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, key: str, ids: bytes) -> None:
        if len(key) > CACHE_CHARS:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = ids


def raw(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[start : start + size]`` of the picked ones in a row, and how long each is."""
    n = size[picked]
    behind = np.cumsum(n)
    at = np.repeat(start[picked] - behind + n, n) + np.arange(n.sum())
    return flat[at], n


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Normalising, splitting and caching; how a piece becomes ids is left to ``piece_ids``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        #: the file's own expression; pieces hold no blanks here, so its blanks don't matter
        self._pieces = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.symbols = byte_symbols()
        self._bytes = {s: b for b, s in enumerate(self.symbols)}
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._added = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self._odd = TwoGenerations(CACHE_CHUNKS)
        self._known = TwoGenerations(CACHE_PIECES)

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece that isn't empty."""
        raise NotImplementedError

    def _cached(self, cache: TwoGenerations, keys: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        out = list(map(cache.young.get, keys))
        i = -1
        for _ in range(out.count(None)):
            i = out.index(None, i + 1)
            ids = out[i] = cache.old.get(keys[i]) or make(keys[i])
            cache.put(keys[i], ids)
        return out

    def _piece(self, piece: str) -> bytes:
        return self.piece_ids(piece) if piece else b""

    def _odd_chunk(self, chunk: str) -> bytes:
        """A chunk without control strings that the library normalises and splits."""
        text = self.library.normalizer.normalize_str(chunk)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        pieces = [bytes(map(self._bytes.__getitem__, x)).decode() for x, _ in found]
        return b"".join(self._cached(self._known, pieces, self._piece))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks: all ids, and where in them each chunk's begin and how many they are."""
        simple = pc.match_substring_regex(chunks, SIMPLE)
        is_simple = simple.to_numpy(zero_copy_only=False).astype(bool)
        low = pc.utf8_lower(chunks.filter(simple))
        parted = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(low, self._pieces, r"\0 "), " "), " ")
        pieces = parted.flatten().dictionary_encode()
        known = self._cached(self._known, strings(pieces.dictionary), self._piece)
        size = np.fromiter(map(len, known), "i8", len(known)) // 4
        ids, n = gathered(np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size, size, pieces.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(n)])[parted.offsets.to_numpy()]
        odd = self._cached(self._odd, strings(chunks.filter(pc.invert(simple))), self._odd_chunk)
        sizes = np.zeros(len(chunks), "i8")
        sizes[is_simple] = np.diff(ends)
        sizes[~is_simple] = np.fromiter(map(len, odd), "i8", len(odd)) // 4
        starts = np.zeros(len(chunks), "i8")
        starts[is_simple] = ends[:-1]
        starts[~is_simple] = len(ids) + np.cumsum(sizes[~is_simple]) - sizes[~is_simple]
        return np.concatenate([ids, np.frombuffer(b"".join(odd), "<u4")]), starts, sizes

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """No piece spans a blank, so texts are encoded blank by blank."""
        parted = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = parted.flatten().dictionary_encode()
        ids, n = gathered(*self._chunks(chunks.dictionary), chunks.indices.to_numpy())
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[parted.offsets.to_numpy()])

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in a row (unsigned, 32 bits), and how many each text has; null is empty."""
        texts = texts.fill_null("")
        if not any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added):
            return self._plain(texts)
        plain, control, row = [], [], []
        for i, text in enumerate(strings(texts)):
            parts = [*self._added.split(text), None]  # plain text and control strings take turns
            plain += parts[::2]
            control += [-1 if t is None else self.added[t] for t in parts[1::2]]
            row += [i] * (len(parts) // 2)
        ids, n = self._plain(pa.array(plain, pa.string()))
        control = np.array(control, "i8")
        ids = np.insert(ids, np.cumsum(n)[control >= 0], control[control >= 0].astype("<u4"))
        return ids, np.bincount(row, n + (control >= 0), len(texts)).astype("i8")

    def encode(self, text: str | None) -> list[int]:
        with without_cycle_search():
            return self.encode_texts(pa.array([text], pa.string()))[0].tolist()


class BpeCodec(ChunkEncoder):
    """Encoder and decoder for a ``tokenizers`` file of the word-BPE kind, with merging of its own."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.strings: list[str] = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = token
        self._inner = [vocab[s] for s in self.symbols]
        self._last = [vocab[s + suffix] for s in self.symbols]
        #: left id << 32 | right id -> (rank, id of the merged symbol)
        self._merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self._merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])

    def piece_ids(self, piece: str) -> bytes:
        return raw(self.merge(piece.encode()))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece of text, merged lowest rank first, leftmost among equals."""
        n = len(word)
        if not n:
            return []
        ids = [self._inner[b] for b in word]
        ids[-1] = self._last[word[-1]]
        merges = self._merges
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        queue: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            if found := merges.get(ids[i] << 32 | ids[i + 1]):
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get(ids[i] << 32 | ids[j], (-1,))[0] != rank:
                continue  # stale: a neighbour was merged since
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get(merged << 32 | ids[k]):
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get(ids[h] << 32 | merged)):
                heapq.heappush(queue, (found[0], h, found[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings one after the other; without a decoder the library puts a blank between."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder(kind: type[ChunkEncoder], path: str) -> ChunkEncoder:
    """The encoder that a Python process holds, with its caches."""
    return kind(path)


def codec(path: str) -> BpeCodec:
    return encoder(BpeCodec, path)


def release() -> None:
    """Give back what an encoder holds; Spark goes on with the process for other operators."""
    encoder.cache_clear()


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` of every text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices_of_bytes(batch, 1):
                with without_cycle_search():
                    ids, n = c.encode_texts(part.column(1))
                yield pa.record_batch([part.column(0), id_lists(ids, n)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` out of ``doc_id, ids``; null ids give the empty text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                texts = [c.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """The caches hold no cycles; searching them for some takes a tenth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that Python objects of one slice only are alive."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices_of_bytes(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows whose texts hold ``size`` bytes in sum, or the one row that holds more."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype="i8")
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def id_lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype("i4")))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded string``: every text encoded, and its ids decoded.

    One pass without a shuffle, a few megabytes at a time.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices_of_bytes(batch, 1):
                with without_cycle_search():
                    ids, n = c.encode_texts(part.column(1))
                    texts = [c.decode(x.tolist()) for x in np.split(ids, np.cumsum(n)[:-1])]
                columns = [part.column(0), id_lists(ids, n), pa.array(texts, pa.string())]
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"])

    out = "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)
