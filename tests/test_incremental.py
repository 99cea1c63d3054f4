"""A store that is changed step by step equals one that is made at once, and writes what changes."""

from __future__ import annotations

import random

import pytest

from quillmesh.config import Settings
from quillmesh.snapshots import Snapshots
from quillmesh.store import SCHEMAS, KnowledgeStore

FILES = "relative_path string, text string"
SETTINGS = Settings(medium_tokens=16, overlap_tokens=2)


def extractor(text):
    """Words are entities, ``a=b`` gives an alias, neighbours are related."""
    said = [w.split("=") for w in dict.fromkeys(text.split())]
    return {
        "entities": [{"local_id": str(i), "keyword": w[0], "aliases": w[1:], "summary": f"on {w[0]} {len(text)}", "evidence_weight": (len(text) % 7 + 1) / 8} for i, w in enumerate(said)],
        "relations": [{"source": str(i), "relation": "then", "target": str(i + 1), "evidence_weight": (len(text) % 5 + 1) / 8} for i in range(len(said) - 1)],
    }


def store(spark, path):
    return KnowledgeStore(spark, str(path), SETTINGS, extractor=extractor)


def rows(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def same(a, b, names=tuple(SCHEMAS)):
    for name in names:
        columns = a.columns(name)
        assert rows(a.read(name).select(*columns)) == rows(b.read(name).select(*columns)), name


def test_history_equals_a_new_store(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(30):02}"
    text = lambda: " ".join(f"{word()}={word()}" if rng.random() < 0.25 else word() for _ in range(rng.randrange(1, 6)))
    files = {f"f{i}.md": text() for i in range(8)}
    frame = lambda: spark.createDataFrame(sorted(files.items()), FILES)
    s = store(spark, tmp_path / "steps")
    s.ingest(frame())
    for step in range(2):
        for f in rng.sample(sorted(files), 2):
            files[f] = text()
        files[f"n{step}.md"] = text()
        del files[rng.choice(sorted(files))]
        s.ingest(frame())
    assert s.violations().isEmpty()
    new = store(spark, tmp_path / "new")
    new.ingest(frame())
    live = [n for n in SCHEMAS if n != "sources"]
    same(s, new, live)
    kept = "exists_status = 'active'"
    assert rows(s.read("sources").filter(kept).drop("relative_path")) == rows(new.read("sources").filter(kept).drop("relative_path"))

    # what nobody names any more goes, and a delete equals a store that never had the source
    gone = new.read("sources").filter(kept).orderBy("source_id").first()
    assert s.delete_sources([gone.source_id]) == 1
    del files[gone.relative_path]
    left = store(spark, tmp_path / "left")
    left.ingest(frame())
    same(s, left, live)
    version = s.version()
    s.ingest(frame())
    assert s.version() == version  # nothing to do is no version
    assert s.vacuum(keep=1, older=0) > 0
    same(s, left, live)


def test_a_hundredth_changed_writes_about_a_hundredth(spark, tmp_path):
    rng = random.Random(2)
    # names of their own, some of them shared by a few files, and one by a third of all
    text = lambda i: " ".join([f"own{i}x{k}" for k in range(40)] + [f"shared{i // 5}", *(["common"] * (i % 3 == 0))]) + " " + "pad" * rng.randrange(3)
    files = {f"f{i:04}.md": text(i) for i in range(300)}
    s = store(spark, tmp_path / "large")
    frame = lambda: spark.createDataFrame(sorted(files.items()), FILES)
    s.ingest(frame())
    whole = s.bytes_held()
    for i in (7, 100, 250):
        files[f"f{i:04}.md"] = text(i).replace("x1 ", "y1 ") + " added"
    s.ingest(frame())
    assert s.bytes_written(s.version()) < 0.06 * whole  # a file of Parquet has a few kilobytes of its own
    parts = s.manifest()["nodes"]["parts"]
    assert len(parts) == 2 and parts[1]["rows"] < 0.05 * parts[0]["rows"]
    assert s.read("nodes").filter("keyword = 'added'").first().ref_count == 3
    one = spark.createDataFrame([(parts[0]["files"][0][1],)], "node_id string")
    assert s.read_keys("nodes", one).count() == 1


def test_parts_merge_and_versions_stay(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), {"t": "k string, v long"}, {"t": ("k",)})
    make = lambda pairs: spark.createDataFrame(pairs, "k string, v long")
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "k string")
    held, versions = {}, {}
    rng = random.Random(0)
    for step in range(12):
        size = 400 if step == 0 else rng.choice([1, 5, 40])
        fresh = {f"k{rng.randrange(600):03}": step for _ in range(size)}
        gone = {f"k{rng.randrange(600):03}" for _ in range(size // 4)} - set(fresh)
        t.commit({}, None, {"t": (make(sorted(fresh.items())), keys(sorted(set(fresh) | gone)))})
        held = {k: v for k, v in held.items() if k not in gone} | fresh
        versions[t.version()] = dict(held)
        parts = t.manifest()["t"]["parts"]
        assert all(a["rows"] > 2 * b["rows"] for a, b in zip(parts, parts[1:], strict=False)) and len(parts) <= 6
    for v in (1, 5, 12):
        assert dict(map(tuple, t.read("t", v).collect())) == versions[v]
    some = sorted(held)[::50]
    assert dict(map(tuple, t.read_keys("t", keys(some)).collect())) == {k: held[k] for k in some}
    t.commit({}, None, {"t": (make([]), keys(sorted(held)))})
    assert t.read("t").isEmpty()


def test_rebuild_leaves_no_shadow(spark, tmp_path):
    s = store(spark, tmp_path / "r")
    files = spark.createDataFrame([("a.md", "one two"), ("b.md", "two=one three")], FILES)
    s.ingest(files)
    before = {n: rows(s.read(n)) for n in ("nodes", "edges", "chunks")}
    s.rebuild(files)
    assert {n: rows(s.read(n)) for n in before} == before
    assert not list((tmp_path / "r").glob("shadow-*"))
    with pytest.raises(KeyError):
        s.delete_node("no")


def test_texts_and_chunks_are_not_copied(spark, tmp_path, monkeypatch):
    """Texts are read from the files when they are needed, chunks written once, and nothing stays beside the tables."""
    from quillmesh import snapshots
    from quillmesh import store as module

    written = []
    for m in (snapshots, module):
        monkeypatch.setattr(m, "durable", lambda df, keep=m.durable: written.append(df.columns) or keep(df))
    s = store(spark, tmp_path / "s")
    files = {f"f{i}.md": f"alpha w{i} beta w{i + 1}" for i in range(12)}
    frame = lambda: spark.createDataFrame(sorted(files.items()), FILES)
    s.ingest(frame())
    assert not any({"text", "content"} & set(columns) for columns in written)
    files["f3.md"] = "gamma w3 delta"
    del files["f4.md"]
    assert s.ingest(frame()) == {"graph": 1, "rag": 1, "deleted": 1, "failed": 0}
    assert not any("text" in columns for columns in written)
    assert list((tmp_path / "s" / "staged").iterdir()) == []
    assert s.violations().isEmpty() and s.read("chunks").count() == 11
    assert s.vacuum(keep=1, older=0) > 0 and s.read("chunks").filter("content LIKE '%gamma%'").count() == 1
    # files that aren't the same when they are read again
    import os

    from pyspark.sql import functions as F

    anew = F.udf(lambda path, text: os.urandom(8).hex() if path == "f5.md" else text).asNondeterministic()
    other = frame().withColumn("text", anew("relative_path", "text"))
    with pytest.raises(Exception, match="isn't what it was"):
        s.ingest(other)
    assert s.read("chunks").count() == 11
