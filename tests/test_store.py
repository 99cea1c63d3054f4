from __future__ import annotations

import pytest

from quillmesh.cache import SearchCache
from quillmesh.config import Settings, settings_of
from quillmesh.operators.drafts import Draft, merge_drafts, parse_draft
from quillmesh.store import Conflict, KnowledgeStore

FILES = "relative_path string, text string"


def extractor(text):
    if "BROKEN" in text:
        raise ValueError("no")
    names = [w for w in dict.fromkeys(text.split()) if w[0].isupper()]
    return {
        "entities": [{"local_id": n, "keyword": n, "evidence_weight": 0.9 if "strong" in text else 0.5} for n in names],
        "relations": [{"source": a, "relation": "knows", "target": b, "evidence_weight": 0.9 if "strong" in text else 0.5} for a, b in zip(names, names[1:], strict=False)],
    }


def store(spark, path, **k):
    return KnowledgeStore(spark, str(path), Settings(medium_tokens=16, overlap_tokens=2, **k), extractor=extractor)


def test_life_of_a_store(spark, tmp_path):
    s = store(spark, tmp_path / "a")
    two = [("high.md", "strong words about SharedA and SharedB"), ("low.md", "weak words about SharedA and SharedB")]
    frame = lambda rows: spark.createDataFrame(rows, FILES)
    assert s.ingest(frame(two)) == {"graph": 2, "rag": 2, "deleted": 0, "failed": 0}
    assert {(r.keyword, r.weight, r.ref_count) for r in s.read("nodes").collect()} == {("SharedA", 0.9, 2), ("SharedB", 0.9, 2)}
    assert [(r.weight, r.support_count) for r in s.read("edges").collect()] == [(0.9, 2)]
    assert s.violations().count() == 0 and s.read("chunk_nodes").count() == 4
    before = s.revision()
    assert s.ingest(frame(two)) == {"graph": 0, "rag": 0, "deleted": 0, "failed": 0}

    found = s.rag("SharedA", threshold=0.5)
    assert found.count() == 2 and {r.relative_path for r in found.collect()} == {"high.md", "low.md"}
    got = s.graph("SharedA", depth=1)
    assert {r.keyword for r in got["nodes"].collect()} >= {"SharedA"} and got["edges"].count() == 1
    assert s.sync_entity_vectors() == 2 and s.sync_entity_vectors() == 0
    assert s.hybrid("SharedA")["entities"].count() == 2
    assert "Shared" in s.answer("SharedA")
    assert s.answer("SharedA", lambda q, c: str(len(c))) != "0"

    assert s.ingest(frame(two[1:]))["deleted"] == 1
    assert [(r.weight, r.support_count) for r in s.read("edges").collect()] == [(0.5, 1)]
    assert s.revision() != before
    bad = [("low.md", "BROKEN")]
    assert s.ingest(frame(bad))["failed"] == 1
    row = s.read("sources").filter("relative_path = 'low.md'").first()
    assert row.graph_status == "failed" and row.rag_status == "ready" and s.read("edges").count() == 1
    assert s.ingest(frame([]))["deleted"] >= 1 and s.read("nodes").count() == 0 and s.read("chunks").count() == 0


def test_communities_rebuild_and_conflicts(spark, tmp_path):
    s = store(spark, tmp_path / "b", chunking_mode="hierarchical", small_tokens=4, large_tokens=32)
    files = spark.createDataFrame([("x.md", "A B C D E " + "w " * 60)], FILES)
    s.ingest(files)
    assert {r.granularity for r in s.read("chunks").collect()} == {"small", "medium", "large"}
    assert s.summarise() == 1 and s.summarise(lambda names: f"about {names}") == 1
    assert s.read("groups").first().summary.startswith("about A")
    assert s.key_entities("A").count() == 5
    version = s.version()
    assert s.rebuild(files) == version + 1 and s.violations().count() == 0
    with pytest.raises(Conflict):
        s.commit({"groups": s.read("groups")}, version)
    with pytest.raises(ValueError):
        s.ingest(spark.createDataFrame([("a.md", ""), ("A.md", "")], FILES))


def test_drafts():
    a = {"entities": [{"local_id": "1", "keyword": "Alpha", "evidence_weight": 0.5}, {"local_id": "2", "keyword": "Beta"}], "relations": [{"source": "1", "relation": "r", "target": "2"}]}
    b = {"entities": [{"local_id": "1", "keyword": "Alpha alias", "aliases": ["ALPHA"], "evidence_weight": 0.9}, {"local_id": "2", "keyword": "Gamma"}], "relations": [{"source": "1", "relation": "r", "target": "2"}]}
    m = merge_drafts([parse_draft(a), parse_draft(b)])
    assert [e.keyword for e in m.entities] == ["Alpha", "Beta", "Gamma"] and len(m.relations) == 2
    assert m.entities[0].weight == 0.9 and m.entities[0].aliases == ("Alpha alias",)
    assert merge_drafts([]) == Draft()
    for wrong in ({"x": 1}, {"entities": [{"local_id": "1", "keyword": ""}]}, {"entities": [{"local_id": "1", "keyword": "a", "evidence_weight": 2}]}, {"relations": [{"source": "1", "relation": "r", "target": "2"}]}):
        with pytest.raises(ValueError):
            parse_draft(wrong)


def test_deletes_cascade_and_clear_the_cache(spark, tmp_path):
    cache = SearchCache()
    s = store(spark, tmp_path / "deletes")
    s.cache = cache
    three = [("a.md", "strong words on Alpha and Beta"), ("b.md", "words on Alpha and Gamma"), ("c.md", "only Beta here")]
    files = spark.createDataFrame(three, FILES)
    s.ingest(files)
    ask = lambda: cache.run("rag", "q", s.revision, lambda: 1)
    node = {r.keyword: r.node_id for r in s.read("nodes").collect()}
    path = {r.source_id: r.relative_path for r in s.read("sources").collect()}
    edge = s.read("edges").filter(f"target_node_id = '{node['Beta']}'").first()
    told = s.relation(edge.edge_id).collect()
    assert [(r.source, r.relation, r.target, r.support_count, r.relative_path, r.evidence_weight) for r in told] == [("Alpha", "knows", "Beta", 1, "a.md", 0.9)]

    ask()
    s.delete_relation(edge.edge_id)
    assert cache.listed("") == [] and s.read("edges").count() == 1 and s.read("nodes").count() == 3
    assert s.delete_node(node["Beta"]) == 1  # c.md names nothing else
    assert {r.keyword for r in s.read("nodes").collect()} == {"Alpha", "Gamma"} and s.violations().isEmpty()
    live = s.read("sources").filter("exists_status = 'active'").collect()
    assert {r.relative_path for r in live} == {"a.md", "b.md"} == {path[r.source_id] for r in s.read("chunks").collect()}
    gone = next(k for k, v in path.items() if v == "b.md")
    assert s.delete_sources([gone, gone, "unknown"]) == 1
    assert {(r.keyword, r.weight) for r in s.read("nodes").collect()} == {("Alpha", 0.9)} and s.read("edges").count() == 0 and s.violations().isEmpty()
    for wrong in (lambda: s.delete_node("no"), lambda: s.delete_relation("no")):
        with pytest.raises(KeyError):
            wrong()
    assert s.ingest(files) == {"graph": 2, "rag": 2, "deleted": 0, "failed": 0}  # what was deleted and is still a file comes back
    assert s.read("edges").count() == 1


def test_cache():
    c = SearchCache(most=2)
    state = ["s1"]
    calls = []

    def run():
        calls.append(1)
        return {"n": len(calls)}

    ask = lambda q: c.run("rag", q, lambda: state[0], run)
    assert ask("  ＡＢＣ ") == ({"n": 1}, False) and ask("ABC") == ({"n": 1}, True)
    state[0] = "s2"
    assert ask("ABC")[1] is False and [e["is_stale"] for e in c.listed("s2")] == [True, False]
    assert c.clear("s2") == 1 and c.clear() == 1
    for q in "abc":
        ask(q)
    assert len(c.listed("s2")) == 2
    moving = iter(range(100))
    assert c.run("rag", "z", lambda: str(next(moving)), run)[1] is False
    assert all(e["query"] != "z" for e in c.listed("")) and not c._flights


def test_who_waits_for_a_failure_stays_one_flight():
    import threading
    import time

    c, running, most, failed = SearchCache(), [], [], []
    guard = threading.Lock()

    def run():
        with guard:
            running.append(1)
            most.append(len(running))
            first = not failed
            failed.append(1)
        time.sleep(0.2)
        with guard:
            running.pop()
        if first:
            raise OSError("once")
        return {"n": 1}

    def ask(delay):
        time.sleep(delay)
        try:
            c.run("rag", "q", lambda: "s", run)
        except OSError:
            pass

    threads = [threading.Thread(target=ask, args=(d,)) for d in (0.0, 0.05, 0.25)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert max(most) == 1 and len(failed) == 2 and not c._flights


def test_settings_are_lenient():
    assert settings_of({"top_k": 3, "rrf_k": "x", "anchor_factor": 2, "no": 1, "max_entities": True}) == Settings(top_k=3, anchor_factor=2.0)


def test_dense_sections_lose_no_name(spark):
    from quillmesh.operators.drafts import MOST_ENTITIES, extract_mentions, rule_extractor

    few = "".join(f"# Heading {i}\n" for i in range(60)) + "Recurring and Recurring"
    assert "Recurring" in {e["keyword"] for e in rule_extractor(few)["entities"]}
    many = MOST_ENTITIES + 1200
    said = spark.createDataFrame([("s", "h", " ".join(f"N{i:04} N{i:04}" for i in range(many)))], "source_id string, content_hash string, text string")
    rows = extract_mentions(said, rule_extractor, 100_000).collect()
    assert not [r.error for r in rows if r.error]
    assert {r.keyword for r in rows if r.relation is None} == {f"N{i:04}" for i in range(many)}
    assert len([r for r in rows if r.relation is None]) == many and len([r for r in rows if r.relation]) == many - 1


def test_a_claim_that_was_left_runs_out(spark, tmp_path, monkeypatch):
    from quillmesh import snapshots as module

    s = store(spark, tmp_path / "left")
    rows = spark.createDataFrame([("a.md", "some Alpha text")], FILES)
    s.ingest(rows)
    (tmp_path / "left" / "manifests" / f"{s.version() + 1}.claim").touch()  # a writer died here
    with pytest.raises(Conflict):
        s.commit({"groups": s.read("groups")})
    monkeypatch.setattr(module, "CLAIM_SECONDS", 0)
    assert s.commit({"groups": s.read("groups")}) == s.version()


def test_an_ingest_embeds_each_chunk_once(spark, tmp_path):
    log = tmp_path / "seen"

    def embedder(texts):
        with open(log, "a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    s = KnowledgeStore(spark, str(tmp_path / "s"), Settings(medium_tokens=4, overlap_tokens=0), embedder=embedder, extractor=extractor)
    files = [(f"{i}.md", " ".join(f"w{i}x{j}" for j in range(10))) for i in range(6)]
    s.ingest(spark.createDataFrame(files, "relative_path string, text string"))
    chunks = [r["content"] for r in s.read("chunks").collect()]
    assert len(chunks) == 18 and sorted(log.read_text().splitlines()) == sorted(map(repr, chunks))
    files[0] = ("0.md", "new words")
    s.ingest(spark.createDataFrame(files, "relative_path string, text string"))
    assert len(log.read_text().splitlines()) == 19
    assert {r["embedding"][0] for r in s.read("vectors").filter("chunk_id LIKE '%:0'").collect()} == {float(len(t)) for t in ("new words", "w1x0 w1x1 w1x2 w1x3")}


def test_held_words_change_no_vector(monkeypatch):
    from quillmesh.sources import models

    texts = ["one two three two", "three four " + "w" * 40, "", "a b", "two two one"]
    want = models.HashEmbedder(16)(texts)
    assert want[2] == [0.0] * 16 and all(isinstance(x, float) for v in want for x in v)
    monkeypatch.setattr(models, "HELD_WORDS", 2)
    models._held.clear()
    assert models.HashEmbedder(16)(texts) == want and len(models._held[16]) <= 2


def test_without_is_one_comparison(spark):
    from quillmesh.store import without

    kind = "a string, b array<string>"
    a = spark.createDataFrame([("x", ["1"]), ("x", ["1"]), (None, None), ("y", [])], kind)
    b = spark.createDataFrame([(None, None), ("y", ["2"]), ("x", ["1"])], kind)
    fresh, gone = without(a, b)
    assert [tuple(r) for r in fresh.collect()] == [("y", [])] and [tuple(r) for r in gone.collect()] == [("y", ["2"])]
