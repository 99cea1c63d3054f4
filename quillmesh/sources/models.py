"""Models as callables, with deterministic defaults that need no network.

Embedders take a list of texts and give a list of vectors; they run on the executors, in
batches.  Rerankers and chat models run on the driver over capped candidate lists.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import key_of

Embedder = Callable[[list[str]], list[list[float]]]


#: Places of words a process has met, by number of dimensions; emptied when full, and longer words aren't kept.
HELD_WORDS, HELD_SIGNS = 1 << 18, 32
_held: dict[int, dict[str, int]] = {}


@dataclass(frozen=True)
class HashEmbedder:
    """Words hashed into a fixed number of signed buckets, length 1: like texts get near vectors."""

    dimensions: int = 64
    name: str = "hash-64"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = re.findall(r"\w", text) if not re.search(r"\w\w", text) else re.findall(r"\w+", key_of(text))
            n = np.bincount(np.array(self._places(words), dtype=np.int64), minlength=2 * self.dimensions)
            v = (n[: self.dimensions] - n[self.dimensions :]).astype(np.float64)
            size = float(np.linalg.norm(v))
            out.append((v / size if size else v).tolist())
        return out

    def _places(self, words: list[str]) -> list[int]:
        """A word's bucket, or that and the number of buckets if its sign is minus."""
        held = _held.setdefault(self.dimensions, {})
        found = list(map(held.get, words))
        for i in [i for i, at in enumerate(found) if at is None]:
            h = int.from_bytes(hashlib.blake2b(words[i].encode(), digest_size=8).digest(), "little")
            found[i] = h % self.dimensions + (0 if h >> 63 else self.dimensions)
            if len(words[i]) <= HELD_SIGNS:
                if len(held) >= HELD_WORDS:
                    held.clear()
                held[words[i]] = found[i]
        return found


def checked(texts: list[str], vectors: list[list[float]], dimensions: int | None) -> list[list[float]]:
    """A model's answer: one finite vector a text, all of one length."""
    if len(vectors) != len(texts):
        raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
    sizes = {len(v) for v in vectors}
    if len(sizes) > 1 or (dimensions and sizes - {dimensions}):
        raise ValueError(f"vectors have lengths {sorted(sizes)}")
    if not all(math.isfinite(x) for v in vectors for x in v):
        raise ValueError("a vector isn't finite")
    return vectors


def embed(rows: DataFrame, text: str, model: Embedder, dimensions: int | None = None, batch: int = 8, keep_text: bool = True) -> DataFrame:
    """The rows with ``vector``, if asked without the text; the model sees ``batch`` texts at a time."""
    kept = [c for c in rows.columns if keep_text or c != text]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            found: list[list[float]] = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                found += checked(part, model(part), dimensions)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.list_(pa.float32()))], [*kept, "vector"])

    return rows.mapInArrow(run, f"{kinds}, vector array<float>")


def rerank_rows(candidates: DataFrame, query: str, model: Callable[[str, list[str]], list[tuple[int, float]]], limit: int) -> DataFrame:
    """Candidates with a model's scores and ranks; its answer must name each place once, finitely."""
    rows = candidates.orderBy(F.desc("score"), "chunk_id").limit(limit).collect()  # a capped pool
    said = model(query, [r["content"] for r in rows]) if rows else []
    places = [i for i, _ in said]
    if len(set(places)) != len(places) or not all(0 <= i < len(rows) and math.isfinite(s) for i, s in said):
        raise ValueError("the reranker's answer doesn't fit its candidates")
    ranked = sorted(said, key=lambda x: (-x[1], x[0]))
    table = [(rows[i]["chunk_id"], float(s), n) for n, (i, s) in enumerate(ranked, 1)]
    return candidates.join(F.broadcast(candidates.sparkSession.createDataFrame(table, "chunk_id string, rerank_score double, rerank_rank int")), "chunk_id")


def fenced_json(said: str) -> object:
    """JSON out of a model's reply, fenced or not."""
    m = re.search(r"```(?:json)?\s*(.*?)```", said, re.S)
    return json.loads(m[1] if m else said)
