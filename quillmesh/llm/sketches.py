"""Shingle sets of texts and their HyperMinHash sketches, in NumPy.

Words are lower-cased in A-Z only and parted at ASCII white space.  A text's set holds the
64-bit hashes of its distinct shingles; a text of fewer words has one shingle, its whole
word sequence, and a text without words the empty set.

A sketch has a number of buckets.  A shingle's hash picks a bucket; of the smallest second
hash in a bucket the register keeps the count of leading zeros (6 bits) and the bits that
follow the leading one (mantissa, 26 bits).  An empty bucket borrows the register of the
filled bucket that comes first in its own fixed random order of buckets, so that registers
of two sets agree with a probability of their Jaccard similarity however small the sets.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

MANTISSA = 26
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = 0x9E3779B97F4A7C15
_BLANK = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (SplitMix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """P ** i modulo 2 ** 64, as far as the longest word seen."""

    def __init__(self) -> None:
        self.up = np.ones(1, "u8")

    def reach(self, n: int) -> np.ndarray:
        while len(self.up) < n:
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_P, len(self.up), 1 << 64))])
        return self.up


_powers = _Powers()
_letters = mix(np.arange(1, 257, dtype="u8") * np.uint64(0xD6E8FEB86659FD93))
#: Bytes hashed at once, so that the arrays beside a text stay small.
PIECE = 1 << 20


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), which follow each other with gaps of any length."""
    if not len(start):
        return np.zeros(0, "u8")
    size = end - start
    up = _powers.reach(int(size.max()))
    inside = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    value = _letters[data[inside]] * up[inside - np.repeat(start, size)]
    return mix(np.add.reduceat(value, np.concatenate([[0], np.cumsum(size)[:-1]])) + size.astype("u8"))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    out, at = [], 0
    while at < len(raw):
        to = at + PIECE
        if to < len(raw):  # pieces end at a blank
            blank = _BLANK.search(raw, to)
            to = blank.start() if blank else len(raw)
        words = raw[at:to].split()
        at = to
        if words:
            joined = np.frombuffer(b" ".join(words), np.uint8)
            gaps = np.flatnonzero(joined == 32)
            out.append(hash_words(joined, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])))
    return np.concatenate(out) if out else np.zeros(0, "u8")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = word_hashes(text) if text else np.zeros(0, "u8")
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    width = min(k, len(words))
    total = np.full(n, width, "u8")
    for i in range(width):
        total = mix(total + words[i : i + n] * np.uint64(2 * i + 0x9E3779B1))
    return np.unique(total)


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set: equal sets have equal signatures."""
    a = mix(shingles * np.uint64(0xA24BAED4963EE407))
    b = mix(shingles ^ np.uint64(0x9FB21C651E98DF25))
    return np.array([a.sum(dtype="u8"), b.sum(dtype="u8") + np.uint64(len(shingles))], "u8").tobytes()


@lru_cache(maxsize=4)
def _orders(registers: int) -> np.ndarray:
    """Row i: the place of each bucket in bucket i's order."""
    i = np.arange(registers, dtype="u8")
    keys = mix((i[:, None] << np.uint64(32) | i[None, :]) + np.uint64(0x5851F42D4C957F2D))
    return keys.argsort(1).argsort(1).astype("u2")


def sketch(shingles: np.ndarray, registers: int) -> np.ndarray:
    """HyperMinHash registers of a set that isn't empty."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
    second = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    order = np.argsort(second)[::-1]
    least = np.zeros(registers, "u8")
    held = np.zeros(registers, bool)
    least[bucket[order]] = second[order]  # of a bucket's values the last assigned stays: the smallest
    held[bucket] = True
    if not held.all():
        filled, empty = np.flatnonzero(held), np.flatnonzero(~held)
        least[empty] = least[filled[_orders(registers)[empty[:, None], filled].argmin(1)]]
    zeros = np.zeros(registers, "u8")
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < (np.uint64(1) << np.uint64(64 - step))
        rest[low] <<= np.uint64(step)
        zeros[low] += np.uint64(step)
    fraction = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((np.minimum(zeros, 62) << np.uint64(MANTISSA)) | fraction).astype("u4")


def band_hashes(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` registers, different from band to band."""
    bands = registers.reshape(-1, rows).astype("u8")
    key = np.arange(len(bands), dtype="u8")
    for i in range(rows):
        key = mix(key + bands[:, i] * np.uint64(0x9E3779B97F4A7C15))
    return key


def bands_for(percent: int, missed: float = 1e-7, most: int = 56) -> tuple[int, int]:
    """Rows a band and bands: the most rows at which a pair at the threshold is missed rarely enough."""
    t, best = percent / 100, (1, 1)
    for rows in range(1, 33):
        bands = 1 if t >= 1 else math.ceil(math.log(missed) / math.log1p(-(t**rows)))
        if bands > most:
            break
        best = (rows, bands)
    return best


def expected_collisions(n: np.ndarray, m: np.ndarray, registers: int, mantissa: int) -> np.ndarray:
    """Registers that unrelated sets of n and m shingles share by chance (HyperMinHash paper, large sets)."""
    n, m = np.maximum(n, m).astype("f8"), np.minimum(n, m).astype("f8")
    ratio = np.divide(n, m, out=np.ones_like(n), where=m > 0)
    return 0.169919487159739 * registers * 2.0**-mantissa * 4 * ratio / (1 + ratio) ** 2


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, mantissa: int) -> np.ndarray:
    """Collision-corrected estimate, row by row, from registers a, b with so many mantissa bits, and set sizes n, m."""
    same = (a == b).sum(1)
    return np.maximum(0.0, same - expected_collisions(n, m, a.shape[1], mantissa)) / a.shape[1]
