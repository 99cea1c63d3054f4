"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def shingles(text: str | None, k: int) -> set:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def components(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest reachable doc_id), every pair compared."""
    sets = [shingles(t, k) for _, t in docs]
    up = {d: d for d, _ in docs}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(docs[j][0])))
                up[y] = x
    return {d: (len(s), root(d)) for (d, _), s in zip(docs, sets, strict=True)}


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)
