"""A result cache keyed by mode, query, state and parameters; a transparent wrapper around queries."""

from __future__ import annotations

import hashlib
import json
import threading
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from quillmesh.functions.text import cache_text


@dataclass
class Entry:
    mode: str
    query: str
    state: str
    body: str
    hits: int = 0


def key_for(mode: str, query: str, state: str, config: dict, params: dict) -> str:
    whole = "|".join([mode, cache_text(query), state, json.dumps(config, sort_keys=True, default=str), json.dumps(params, sort_keys=True, default=str)])
    return hashlib.sha256(whole.encode()).hexdigest()


class SearchCache:
    """Least recently used entries go first, when their number or their bytes exceed the limits."""

    def __init__(self, most: int = 10_000, most_bytes: int = 256 << 20):
        self.most, self.most_bytes = most, most_bytes
        self._entries: OrderedDict[str, Entry] = OrderedDict()
        self._bytes = 0
        self._lock = threading.RLock()
        self._flights: dict[str, threading.RLock] = {}

    def get(self, key: str) -> Entry | None:
        with self._lock:
            entry = self._entries.get(key)
            if entry is not None:
                entry.hits += 1
                self._entries.move_to_end(key)
            return entry

    def put(self, key: str, entry: Entry) -> None:
        with self._lock:
            old = self._entries.pop(key, None)
            if old is not None:
                entry.hits = old.hits
                self._bytes -= len(old.body)
            self._entries[key] = entry
            self._bytes += len(entry.body)
            while len(self._entries) > self.most or self._bytes > self.most_bytes:
                _, gone = self._entries.popitem(last=False)
                self._bytes -= len(gone.body)

    def listed(self, state: str) -> list[dict]:
        with self._lock:
            return [{"key": k, "mode": e.mode, "query": e.query, "hits": e.hits, "is_stale": e.state != state} for k, e in self._entries.items()]

    def clear(self, stale_of: str | None = None) -> int:
        """All entries, or those of another state; deletions clear all, as bodies hold deleted text."""
        with self._lock:
            gone = [k for k, e in self._entries.items() if stale_of is None or e.state != stale_of]
            for k in gone:
                self._bytes -= len(self._entries.pop(k).body)
            return len(gone)

    def run(self, mode: str, query: str, state: Callable[[], str], run: Callable[[], object], config: dict | None = None, params: dict | None = None, attempts: int = 3) -> tuple[object, bool]:
        """A result and whether it was cached; one caller computes, stored only if the state stayed."""
        for _ in range(attempts):
            before = state()
            key = key_for(mode, query, before, config or {}, params or {})
            with self._lock:
                flight = self._flights.setdefault(key, [threading.RLock(), 0])
                flight[1] += 1
            try:
                with flight[0]:
                    if (entry := self.get(key)) is not None:
                        return json.loads(entry.body), True
                    result = run()
                    if state() == before:
                        self.put(key, Entry(mode, cache_text(query), before, json.dumps(result, default=str)))
                        return result, False
            finally:  # a flight ends when nobody waits for it any more, so that who comes meanwhile joins it
                with self._lock:
                    flight[1] -= 1
                    if not flight[1]:
                        self._flights.pop(key, None)
        return result, False
