"""Search results as a table: between sessions, writers, ages and clearings."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from quillmesh.cache import Entry
from quillmesh.config import Settings
from quillmesh.operators.results import ResultTable
from quillmesh.store import KnowledgeStore

ROWS = "key string, mode string, query string, state string, body string"


def bytes_with(folder, text: bytes) -> int:
    """Files under a folder that hold a text."""
    return sum(text in open(os.path.join(at, f), "rb").read() for at, _, files in os.walk(folder) for f in files)


def test_a_store_answers_from_the_table_in_another_session(spark, tmp_path):
    files = [("a.md", "# Alpha\n\nAlpha knows Beta."), ("b.md", "# Beta\n\nBeta knows Gamma well.")]
    frame = spark.createDataFrame(files, "relative_path string, text string")
    make = lambda session: KnowledgeStore(session, str(tmp_path / "kb"), Settings(), cache=ResultTable(session, str(tmp_path / "results")))
    s = make(spark)
    s.ingest(frame)
    first, held = s.ask("rag", "who knows Beta", threshold=0.0)
    assert not held and len(first) == 2 and [r["rerank_rank"] for r in first] == sorted(r["rerank_rank"] for r in first)
    again = make(spark.newSession())
    assert again.ask("rag", "who knows Beta", threshold=0.0) == (first, True)
    assert not again.ask("rag", "who knows Beta", threshold=0.1)[1]
    with pytest.raises(ValueError, match="mode"):
        s.ask("revision", "x")
    # a deletion takes results, and the files that held them, away
    assert s.delete_sources([r.source_id for r in s.read("sources").filter("relative_path = 'b.md'").collect()]) == 1
    assert s.cache.listed("") == []
    got, held = again.ask("rag", "who knows Beta", threshold=0.0)
    assert not held and [r["relative_path"] for r in got] == ["a.md"]


def test_results_expire_keep_their_first_time_and_count_uses(spark, tmp_path):
    now = [dt.datetime(2024, 5, 1, 12)]
    make = lambda: ResultTable(spark, str(tmp_path / "r"), dt.timedelta(days=7), clock=lambda: now[0])
    table = make()
    assert table.get("k") is None
    table.put("k", Entry("rag", "q", "s1", "[1]"))
    now[0] += dt.timedelta(days=6)
    assert [table.get("k").body for _ in range(3)] == ["[1]"] * 3
    table.put("k", Entry("rag", "q", "s2", "[2]"))
    other = make()
    assert other.get("k").body == "[2]"
    row = other.entries("s2").collect()
    other.record_uses()
    assert [(r.created_at.day, r.updated_at.day, r.hit_count, r.is_stale) for r in row] == [(1, 7, 3, False)]
    assert other.listed("s1") == [{"key": "k", "mode": "rag", "query": "q", "hits": 4, "is_stale": True}]
    now[0] += dt.timedelta(days=7)
    assert other.get("k") is None
    assert other.prune() == 1 and other.prune() == 0 and other.listed("") == []


def test_limits_states_and_repeated_keys(spark, tmp_path):
    now = [dt.datetime(2024, 5, 1)]
    table = ResultTable(spark, str(tmp_path / "r"), most=2, clock=lambda: now[0])
    for i in range(3):
        now[0] += dt.timedelta(hours=1)
        if i == 2:
            assert table.get("k0").body == "b0"  # used, so the next one goes
        table.put(f"k{i}", Entry("rag", f"q{i}", f"s{i}", f"b{i}"))
    assert {x["key"] for x in table.listed("")} == {"k0", "k2"}
    assert table.clear(stale_of="s2") == 1 and [x["key"] for x in table.listed("s2")] == ["k2"]
    with pytest.raises(ValueError, match="repeat"):
        table.put_many(spark.createDataFrame([("a", "m", "q", "s", "b")] * 2, ROWS))


def test_a_clearing_leaves_no_file_and_no_late_result(spark, tmp_path):
    root = tmp_path / "r"
    table = ResultTable(spark, str(root))
    table.put_many(spark.createDataFrame([("k", "rag", "q", "s", "a secret body")], ROWS))
    assert bytes_with(root, b"secret body") > 0
    assert table.get("late") is None  # begun before
    assert ResultTable(spark, str(root)).clear() == 1
    assert bytes_with(root, b"secret body") == 0
    table.put("late", Entry("rag", "q", "s", "secret body"))
    assert table.listed("s") == [] and bytes_with(root, b"secret body") == 0
    assert table.get("late") is None
    table.put("late", Entry("rag", "q", "s", "fresh"))
    assert table.get("late").body == "fresh"


def test_writers_that_meet_both_store(spark, tmp_path, monkeypatch):
    one, two = (ResultTable(spark, str(tmp_path / "r")) for _ in range(2))
    commit, met = one.table.commit, []

    def late(*args, **kw):
        if not met:
            met.append(two.put("b", Entry("rag", "q", "s", "2")))
        return commit(*args, **kw)

    monkeypatch.setattr(one.table, "commit", late)
    one.put("a", Entry("rag", "q", "s", "1"))
    assert {x["key"] for x in one.listed("s")} == {"a", "b"}


def test_a_broken_cache_costs_no_result(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "r"))
    (tmp_path / "r" / "manifests").mkdir(parents=True)
    (tmp_path / "r" / "manifests" / "1.json").write_text("no manifest")
    with pytest.warns(UserWarning, match="cache"):
        assert table.run("rag", "q", lambda: "s", lambda: [1]) == ([1], False)
