"""Search results kept as a table: other sessions find them, they expire, and a deletion takes them off the disk."""

from __future__ import annotations

import datetime as dt
import warnings
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.cache import Entry, SearchCache
from quillmesh.operators.listing import prune_lru
from quillmesh.plans.components import durable
from quillmesh.snapshots import Conflict, Snapshots

#: How long a result is used.
MAX_AGE = dt.timedelta(days=7)
#: Commits that are tried when other writers come between.
TRIES = 3

SCHEMAS = {
    "results": "key string, mode string, query string, state string, body string, created_at timestamp, updated_at timestamp",
    "uses": "key string, hit_count long, last_hit_at timestamp",
}


class ResultTable(SearchCache):
    """A ``SearchCache`` whose entries are rows under ``root``.

    Writers commit against the version they have read, and try again when another was first; a result that
    was begun before a clearing is never stored after it.  Uses are counted here and written by
    ``record_uses``, which every write calls.  A cache that can't be read or written warns
    and costs its caller nothing but the time.
    """

    def __init__(self, spark: SparkSession, root: str, max_age: dt.timedelta = MAX_AGE, most: int = 10_000, most_bytes: int = 256 << 20, clock: Callable[[], dt.datetime] = dt.datetime.now):
        super().__init__(most, most_bytes)
        self.table = Snapshots(spark, root, SCHEMAS, {"results": ("key",), "uses": ("key",)})
        self.spark, self.max_age, self.clock = spark, max_age, clock
        self._used: Counter[str] = Counter()
        self._taken: dict[str, int] = {}
        self._last: dict[str, dt.datetime] = {}
        self._begun: dict[str, int] = {}

    # ---- single results

    def _generation(self, version: int | None = None) -> int:
        """How often everything has been cleared."""
        return self.table.manifest(version).get("notes", {}).get("generation", 0)

    def get(self, key: str) -> Entry | None:
        try:
            wanted = self.spark.createDataFrame([(key,)], "key string")
            with self._lock:
                self._begun[key] = self._generation()
            row = self.table.read_keys("results", wanted).filter(F.col("updated_at") > F.lit(self.clock() - self.max_age)).first()
        except Exception as why:
            warnings.warn(f"cached results can't be read: {why}", stacklevel=2)
            return None
        if row is None:
            return None
        with self._lock:
            self._used[key] += 1
            self._last[key] = self.clock()
            self._begun.pop(key, None)
        return Entry(row["mode"], row["query"], row["state"], row["body"], self._used[key])

    def put(self, key: str, entry: Entry) -> None:
        with self._lock:
            begun = self._begun.pop(key, None)
        rows = self.spark.createDataFrame([(key, entry.mode, entry.query, entry.state, entry.body)], "key string, mode string, query string, state string, body string")
        try:
            self.put_many(rows, begun)
            held = self.table.manifest()["results"]["parts"]
            if sum(p["rows"] for p in held) > self.most or sum(p["bytes"] for p in held) > self.most_bytes:
                self.prune()
        except Exception as why:
            warnings.warn(f"a result can't be cached: {why}", stacklevel=2)

    # ---- many results

    def _commit(self, change: Callable[[int], dict | None]) -> bool:
        """What ``change`` makes of a version, committed against it; False where there is nothing to do."""
        for left in reversed(range(TRIES)):
            base = self.table.version()
            changes = change(base)
            if changes is None:
                return False
            try:
                self.table.commit({}, base, changes)
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def put_many(self, rows: DataFrame, begun: int | None = None) -> bool:
        """``key, mode, query, state, body``; a key that is there keeps its ``created_at`` and its uses.

        Keys that repeat raise.  With ``begun``, nothing is stored when everything has been cleared since.
        """
        rows, now = durable(rows), F.lit(self.clock())
        if not rows.groupBy("key").count().filter("count > 1").isEmpty():
            raise ValueError("keys repeat")

        def change(base: int) -> dict | None:
            if begun is not None and self._generation(base) != begun:
                return None
            was = self.table.read_keys("results", rows.select("key"), base).select("key", F.col("created_at").alias("_first"))
            fresh = rows.join(was, "key", "left").withColumn("created_at", F.coalesce("_first", now)).withColumn("updated_at", now)
            return {"results": (fresh, rows.select("key")), **self._uses(base)}

        done = self._commit(change)
        self._written()
        return done

    def _uses(self, base: int) -> dict:
        """The change that adds the uses counted here to the table's."""
        with self._lock:
            self._taken = dict(self._used)
            counted = [(k, n, self._last[k]) for k, n in self._used.items()]
        if not counted:
            return {}
        new = self.spark.createDataFrame(counted, SCHEMAS["uses"])
        held = self.table.read_keys("uses", new.select("key"), base)
        summed = new.unionByName(held).groupBy("key").agg(F.sum("hit_count").alias("hit_count"), F.max("last_hit_at").alias("last_hit_at"))
        return {"uses": (summed, new.select("key"))}

    def _written(self) -> None:
        with self._lock:
            self._used -= Counter(self._taken)
            self._taken = {}

    def record_uses(self) -> None:
        """Write the uses that were counted since the last write."""
        self._commit(lambda base: self._uses(base) or None)
        self._written()

    def entries(self, state: str) -> DataFrame:
        """All results with their uses, as ``key, mode, query, state, is_stale, result_size, hit_count, ...``."""
        rows = self.table.read("results").join(self.table.read("uses"), "key", "left")
        size = F.octet_length("body").cast("long").alias("result_size")
        stale = ~F.col("state").eqNullSafe(F.lit(state))
        return rows.select("key", "mode", "query", "state", stale.alias("is_stale"), size, F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "created_at", "updated_at", "last_hit_at")

    def listed(self, state: str) -> list[dict]:
        """The entries as the cache in memory lists them, last used first; at most as many as may be kept."""
        self.record_uses()
        age = F.coalesce("last_hit_at", "updated_at", "created_at")
        rows = self.entries(state).orderBy(F.desc(age), "key").limit(self.most).collect()
        return [{"key": r["key"], "mode": r["mode"], "query": r["query"], "hits": r["hit_count"], "is_stale": r["is_stale"]} for r in rows]

    def _drop(self, gone: Callable[[int], DataFrame]) -> int:
        count = 0

        def change(base: int) -> dict | None:
            nonlocal count
            keys = durable(gone(base).select("key"))
            count = keys.count()
            none = self.table.empty
            return {"results": (none("results"), keys), "uses": (none("uses"), keys)} if count else None

        self._commit(change)
        return count

    def clear(self, stale_of: str | None = None) -> int:
        """All entries, or those of another state than ``stale_of``; returns how many.

        After a clearing of all no file of older versions is left, as their bodies may hold deleted text.
        """
        if stale_of is not None:
            return self._drop(lambda base: self.table.read("results", base).filter(~F.col("state").eqNullSafe(F.lit(stale_of))))
        with self._lock:
            self._used.clear()
        for left in reversed(range(TRIES)):
            base = self.table.version()
            count = self.table.read("results", base).count()
            try:
                version = self.table.commit(dict.fromkeys(SCHEMAS), base, notes={"generation": self._generation(base) + 1})
                break
            except Conflict:
                if not left:
                    raise
        self.table.erase_before(version)
        return count

    def prune(self) -> int:
        """Drop what has expired, then the least recently used until number and bytes fit; returns how many."""
        self.record_uses()
        now = F.lit(self.clock() - self.max_age)

        def gone(base: int) -> DataFrame:
            rows = self.entries("").withColumnRenamed("key", "cache_key")
            live = durable(rows.filter(F.col("updated_at") > now))
            return rows.filter(F.col("updated_at") <= now).select(F.col("cache_key").alias("key")).unionByName(prune_lru(live, self.most, self.most_bytes).select(F.col("cache_key").alias("key")))

        return self._drop(gone)
