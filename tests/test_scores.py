"""A model's rankings in the store, kept between sessions."""

from __future__ import annotations

import datetime as dt

import pytest

from quillmesh.config import Settings
from quillmesh.operators.scores import RerankScores, model_reranker
from quillmesh.store import KnowledgeStore

FILES = "relative_path string, text string"


def test_scores_are_kept_and_expire(spark, tmp_path):
    calls, now = [], [dt.datetime(2024, 5, 1, 12)]

    def model(query, texts):
        calls.append(list(texts))
        return [(i, 0.99 if "second" in t else 0.7) for i, t in enumerate(texts)]

    make = lambda: RerankScores(spark, str(tmp_path / "scores"))
    ask = lambda kept: model_reranker(model, "m1", kept, lambda: now[0])
    files = spark.createDataFrame([(f"{w}.md", f"{w} words about graphs and stores") for w in ("first", "second", "third")], FILES)
    s = KnowledgeStore(spark, str(tmp_path / "store"), Settings(medium_tokens=64, overlap_tokens=4), reranker=ask(make()))
    s.ingest(files)
    best = s.rag("graphs", threshold=0.0).orderBy("rerank_rank").collect()
    assert len(best) == 3 and best[0].relative_path == "second.md" and best[0].effective == 0.99 and len(calls) == 1

    s.reranker = ask(make())  # another session finds them
    assert [r.chunk_id for r in s.rag("graphs", threshold=0.0).orderBy("rerank_rank").collect()] == [r.chunk_id for r in best] and len(calls) == 1
    s.rag("stores", threshold=0.0).collect()
    assert len(calls) == 2  # another question
    now[0] += dt.timedelta(days=8)
    s.rag("graphs", threshold=0.0).collect()
    assert len(calls) == 3  # too old

    kept = make()
    assert kept.prune(s.read("chunks"), now[0]) == 3 and kept.read("scores").count() == 3  # the other question's are too old
    assert kept.prune(s.read("chunks").filter("content NOT LIKE 'third%'"), now[0]) == 1


@pytest.mark.parametrize("answer", [[(0, float("nan"))], [(5, 0.5)], [(0, 0.5), (0, 0.6)]])
def test_answers_that_do_not_fit(spark, answer):
    rows = spark.createDataFrame([("a", "text", 0.5), ("b", "other", 0.4)], "chunk_id string, content string, score double")
    with pytest.raises(ValueError):
        model_reranker(lambda q, t: answer, "m")(rows, "q")
    some = model_reranker(lambda q, t: [(1, 0.5)], "m")(rows, "q").collect()
    assert [(r.chunk_id, r.rerank_rank) for r in some] == [("b", 1)]
    assert model_reranker(lambda q, t: 1 / 0, "m")(rows.limit(0), "q").isEmpty()
