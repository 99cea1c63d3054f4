"""Tables as parts and deletes: what a change writes grows with the change, not with the table.

A table is a list of parts, each of which a commit has written, and of deletes: keys whose rows in
older parts no longer hold.  A manifest names both for every table, with the range of keys of each
file, so that a read of few keys opens only files that can hold them.  A commit that adds rows
also takes in the newest parts that aren't more than twice as large as what it writes, so a table has
about as many parts as the logarithm of its rows and each row is rewritten as rarely.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.components import durable

#: A writer holds a version's number for so long without having written its manifest, which takes a moment.
CLAIM_SECONDS = 600
#: Reads of up to so many keys choose their files; larger ones read all.
FEW_KEYS = 1000
#: Tables of a commit that are written at a time.
WRITERS = 4


@dataclass(frozen=True)
class Staged:
    """Rows that are files already and become a part as they are, if a commit takes them."""

    path: str
    rows: DataFrame


class Conflict(RuntimeError):
    """Somebody else has committed meanwhile."""


class Snapshots:
    """Versions of tables under ``root``; ``schemas`` by name, ``keys`` the columns that name a row or a group of rows."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, Sequence[str]]):
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/manifests/*.json")) or []
        return [int(x.getPath().getName().removesuffix(".json")) for x in found]

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).first()[0])

    def bytes_written(self, version: int) -> int:
        """Bytes of the parts and deletes that a version has added."""
        of = lambda v: {x["path"]: x["bytes"] for t in self.manifest(v).values() for x in (*t["parts"], *t["deletes"])} if v else {}
        before = of(version - 1)
        return sum(n for path, n in of(version).items() if path not in before)

    def bytes_held(self, version: int | None = None) -> int:
        return sum(x["bytes"] for t in self.manifest(version).values() for x in (*t["parts"], *t["deletes"]))

    # ---- reading

    def columns(self, name: str) -> list[str]:
        return [x.split()[0] for x in self.schemas[name].split(", ")]

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[name])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self.manifest(version).get(name)
        return self._live(name, held["parts"], held["deletes"]) if held else self.empty(name)

    def read_keys(self, name: str, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows whose leading key columns are among ``keys``; of few keys only the files that can hold them are opened."""
        held = self.manifest(version).get(name)
        if not held:
            return self.empty(name)
        first = self.keys[name][0]
        few = [r[0] for r in keys.select(first).distinct().limit(FEW_KEYS + 1).collect()]
        wanted = few if len(few) <= FEW_KEYS else None
        return self._live(name, held["parts"], held["deletes"], wanted).join(keys, list(keys.columns), "left_semi")

    def files_of(self, part: dict, wanted: list[str] | None) -> list[str]:
        if wanted is None:
            return [f"{self.root}/{part['path']}"]
        return [f"{self.root}/{part['path']}/{f}" for f, low, high in part["files"] if any(low <= k <= high for k in wanted)]

    def _live(self, name: str, parts: list[dict], deletes: list[dict], wanted: list[str] | None = None) -> DataFrame:
        columns, keys = self.columns(name), list(self.keys[name])
        last = max((d["seq"] for d in deletes), default=-1)
        old, new = None, self.empty(name)
        for part in parts:
            files = self.files_of(part, wanted)
            if not files:
                continue
            rows = self.spark.read.schema(self.schemas[name]).parquet(*files)
            if part["seq"] < last:
                rows = rows.withColumn("_seq", F.lit(part["seq"]))
                old = rows if old is None else old.unionByName(rows)
            else:
                new = new.unionByName(rows)
        if old is None:
            return new
        gone = None
        for d in deletes:
            rows = self.spark.read.parquet(f"{self.root}/{d['path']}").withColumn("_gone", F.lit(d["seq"]))
            gone = rows if gone is None else gone.unionByName(rows)
        gone = gone.groupBy(*keys).agg(F.max("_gone").alias("_gone"))
        return old.join(gone, keys, "left").filter("_gone IS NULL OR _seq >= _gone").select(*columns).unionByName(new)

    # ---- writing

    def stage(self, name: str, rows: DataFrame) -> Staged:
        """Write rows of a table that come in ranges of its key, once, without moving them; a commit renames the files.

        They lie beside the tables, where ``vacuum`` doesn't look, until ``unstage``.
        """
        path = f"staged/{uuid.uuid4().hex}"
        rows.select(*self.columns(name)).write.parquet(f"{self.root}/{path}")
        return Staged(path, self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{path}"))

    def unstage(self, staged: Staged) -> None:
        self._fs.delete(self._path(f"{self.root}/{staged.path}"), True)

    def _write(self, name: str, rows: DataFrame | Staged, seq: int, key: Sequence[str]) -> dict | None:
        """A part, sorted by key; None where there are no rows."""
        path = f"tables/{name}/{uuid.uuid4().hex}"
        if isinstance(rows, Staged):
            self._fs.mkdirs(self._path(f"{self.root}/tables/{name}"))
            self._fs.rename(self._path(f"{self.root}/{rows.path}"), self._path(f"{self.root}/{path}"))
            rows = rows.rows
        else:
            rows.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(f"{self.root}/{path}")
        first = F.col(key[0]).cast("string")
        file = F.element_at(F.split(F.input_file_name(), "/"), -1)
        seen = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}").groupBy(file.alias("f")).agg(F.min(first).alias("low"), F.max(first).alias("high"), F.count("*").alias("n")).collect()  # a row a file
        if not seen:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
            return None
        size = self._fs.getContentSummary(self._path(f"{self.root}/{path}")).getLength()
        return {"path": path, "seq": seq, "rows": sum(r["n"] for r in seen), "bytes": size, "files": sorted([r["f"], r["low"], r["high"]] for r in seen)}

    def _grown(self, name: str, held: dict | None, fresh: DataFrame | Staged, gone: DataFrame, seq: int) -> dict:
        """The table without the rows of ``gone`` keys, and with ``fresh`` rows."""
        parts, deletes = (list(held["parts"]), list(held["deletes"])) if held else ([], [])
        keys = list(self.keys[name])
        staged = fresh if isinstance(fresh, Staged) else None
        fresh, gone = staged.rows if staged else durable(fresh.select(*self.columns(name))), durable(gone.select(*keys).distinct())
        added, removed = fresh.count(), gone.count()
        if not added and not removed:
            return {"parts": parts, "deletes": deletes}
        run, total = [], added + removed
        while parts and parts[-1]["rows"] <= 2 * total:
            run.insert(0, parts.pop())
            total += run[0]["rows"]
        if run:
            kept = self._live(name, run, [d for d in deletes if d["seq"] > run[0]["seq"]])
            fresh = durable(kept.join(gone, keys, "left_anti").unionByName(fresh))
            later = [d for d in deletes if d["seq"] >= run[0]["seq"]]
            deletes = [d for d in deletes if d["seq"] < run[0]["seq"]]
            for d in later:
                gone = gone.unionByName(self.spark.read.parquet(f"{self.root}/{d['path']}"))
            gone, staged = gone.distinct(), None
        part = self._write(name, staged or fresh, seq, keys)
        erased = self._write(f"{name}-deletes", gone, seq, keys) if parts else None
        return {"parts": parts + [p for p in (part,) if p], "deletes": deletes * bool(parts) + [d for d in (erased,) if d]}

    def commit(self, tables: dict[str, DataFrame | Staged | None], base: int | None = None, changes: dict[str, tuple[DataFrame | Staged, DataFrame]] | None = None, notes: dict | None = None) -> int:
        """A version after ``base`` (default: the newest): whole ``tables`` anew, None for an empty one,
        ``changes`` as (rows that come, keys whose rows go), and ``notes`` that the manifest carries."""
        base = self.version() if base is None else base
        names, number = self.manifest(base), base + 1

        def anew(name: str, rows: DataFrame | Staged | None) -> dict:
            if isinstance(rows, DataFrame):
                rows = rows.select(*self.columns(name))
            part = None if rows is None else self._write(name, rows, number, self.keys[name])
            return {"parts": [part] if part else [], "deletes": []}

        # tables are written side by side, as a small change leaves most of a cluster idle
        with ThreadPoolExecutor(WRITERS) as pool:
            done = {name: pool.submit(anew, name, rows) for name, rows in tables.items()}
            done |= {name: pool.submit(self._grown, name, names.get(name), *change, number) for name, change in (changes or {}).items()}
            names |= {name: f.result() for name, f in done.items()}
        if notes is not None:
            names["notes"] = {"parts": [], "deletes": [], **notes}
        return self._publish(names, number)

    def _publish(self, names: dict, number: int) -> int:
        claim, target = self._path(f"{self.root}/manifests/{number}.claim"), self._path(f"{self.root}/manifests/{number}.json")
        self._claim(claim, target, number)
        draft = self._path(f"{self.root}/manifests/.{number}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(names, sort_keys=True).encode()))
        out.close()
        self._fs.rename(draft, target)
        return number

    def _claim(self, claim, target, number: int) -> None:
        """Take a version's number; a claim that a crashed writer left is taken over when it has run out."""
        for _ in range(2):
            try:
                self._fs.create(claim, False).close()
                return
            except Exception as why:
                if self._fs.exists(target) or not self._fs.exists(claim):
                    raise Conflict(f"version {number} is taken") from why
                age = time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000
                left = self._path(f"{self.root}/manifests/.left-{uuid.uuid4().hex}")
                # of several that try, one moves it away
                if age < CLAIM_SECONDS or not self._fs.rename(claim, left):
                    raise Conflict(f"version {number} is taken") from why
        raise Conflict(f"version {number} is taken")

    def adopt(self, other: Snapshots) -> int:
        """All tables of another store as the next version of this one; its files are moved here and its folder goes."""
        names = other.manifest()
        for t in names.values():
            for x in (*t["parts"], *t["deletes"]):
                target = self._path(f"{self.root}/{x['path']}")
                self._fs.mkdirs(target.getParent())
                self._fs.rename(self._path(f"{other.root}/{x['path']}"), target)
        number = self._publish(names, self.version() + 1)
        self._fs.delete(self._path(other.root), True)
        return number

    def drop(self) -> None:
        """Delete the folder with all versions; what was read lazily from it is lost."""
        self._fs.delete(self._path(self.root), True)

    def erase_before(self, version: int) -> None:
        """Delete what only versions before this one name, and those versions; what is being written isn't named yet and stays."""
        older = [v for v in self._versions() if v < version]
        paths = lambda v: {x["path"] for t in self.manifest(v).values() for x in (*t["parts"], *t["deletes"])}
        kept = set().union(*(paths(v) for v in self._versions() if v >= version))
        for path in set().union(*map(paths, older)) - kept:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        for v in older:
            self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)

    def vacuum(self, keep: int = 10, older: float = CLAIM_SECONDS) -> int:
        """Delete folders of tables that none of the ``keep`` newest versions names, unless written just now; returns how many."""
        kept = sorted(self._versions())[-keep:]
        named = {x["path"] for v in kept for t in self.manifest(v).values() for x in (*t["parts"], *t["deletes"])}
        count = 0
        for x in self._fs.globStatus(self._path(f"{self.root}/tables/*/*")) or []:
            path = f"tables/{x.getPath().getParent().getName()}/{x.getPath().getName()}"
            if path not in named and time.time() - x.getModificationTime() / 1000 >= older:
                count += bool(self._fs.delete(x.getPath(), True))
        for v in sorted(set(self._versions()) - set(kept)):
            self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)
        return count
