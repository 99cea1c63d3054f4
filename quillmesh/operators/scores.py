"""A reranking model whose scores are kept: a table of results with expiry, which other sessions find too."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import cache_text
from quillmesh.operators.retrieval import Reranker, read_text
from quillmesh.plans.components import durable
from quillmesh.snapshots import Conflict, Snapshots

#: A question and its texts give a list of (place of a text, score).
Model = Callable[[str, list[str]], list[tuple[int, float]]]
#: Fixed value: how long a ranking is used.
MAX_AGE = dt.timedelta(days=7)


class RerankScores(Snapshots):
    """Scores by question and text: ``request, document, score, cached_at``, without the texts themselves.

    A request is a model's name, the question and the set of texts, so a ranking is found again only for the same
    candidates, in whatever order they come.  Writers that meet leave the work of one of them.
    """

    def __init__(self, spark: SparkSession, root: str, max_age: dt.timedelta = MAX_AGE):
        super().__init__(spark, root, {"scores": "request string, document string, score double, cached_at timestamp"}, {"scores": ("request", "document")})
        self.max_age = max_age

    def found(self, request: str, now: dt.datetime) -> dict[str, float]:
        """Scores of a request that are not too old; a request's rows are as many as a pool has candidates."""
        key = self.spark.createDataFrame([(request,)], "request string")
        rows = self.read_keys("scores", key).filter(F.col("cached_at") > F.lit(now - self.max_age)).collect()
        return {r["document"]: r["score"] for r in rows}

    def keep(self, request: str, scores: dict[str, float], now: dt.datetime) -> bool:
        rows = self.spark.createDataFrame([(request, d, s, now) for d, s in scores.items()], self.schemas["scores"])
        try:
            self.commit({}, None, {"scores": (rows, rows)})
        except Conflict:
            return False
        return True

    def prune(self, chunks: DataFrame, now: dt.datetime) -> int:
        """Drop what is too old or is about texts that no chunk holds any more; returns how many rows went."""
        held = durable(self.read("scores"))
        texts = chunks.select(F.sha2("content", 256).alias("document")).distinct()
        gone = durable(held.filter(F.col("cached_at") <= F.lit(now - self.max_age)).unionByName(held.join(texts, "document", "left_anti").select(*held.columns)).distinct())
        n = gone.count()
        if n:
            self.commit({}, None, {"scores": (self.empty("scores"), gone)})
        return n


def model_reranker(model: Model, name: str, kept: RerankScores | None = None, clock: Callable[[], dt.datetime] = dt.datetime.now) -> Reranker:
    """A reranker for ``rag_query`` out of a model; each of its texts once, by score, then by the order it was asked in.

    A text that the model doesn't score comes behind none: it is left out.  Scores that aren't finite, and places
    that aren't there or come twice, raise.
    """

    def rerank(candidates: DataFrame, query: str) -> DataFrame:
        read = F.coalesce(read_text(candidates), F.lit(""))
        # a pool is capped by its caller
        rows = candidates.orderBy(F.desc("score"), "chunk_id").select("chunk_id", read.alias("text"), F.sha2(read, 256).alias("document")).collect()
        documents = list(dict.fromkeys(r["document"] for r in rows))
        text = {r["document"]: r["text"] for r in rows}
        request = "\n".join([name, cache_text(query), *sorted(documents)])
        spark, now = candidates.sparkSession, clock()
        request = spark.createDataFrame([(request,)], "r string").select(F.sha2("r", 256)).first()[0]
        scores = kept.found(request, now) if kept is not None and documents else {}
        if not scores and documents:
            said = model(query, [text[d] for d in documents])
            places = [i for i, _ in said]
            if len(set(places)) != len(places) or not all(0 <= i < len(documents) and math.isfinite(s) for i, s in said):
                raise ValueError("the reranker's answer doesn't fit its candidates")
            scores = {documents[i]: float(s) for i, s in said}
            if kept is not None and scores:
                kept.keep(request, scores, now)
        at = {d: i for i, d in enumerate(documents)}
        ranked = sorted((r for r in rows if r["document"] in scores), key=lambda r: (-scores[r["document"]], at[r["document"]], r["chunk_id"]))
        table = [(r["chunk_id"], scores[r["document"]], n) for n, r in enumerate(ranked, 1)]
        return candidates.join(F.broadcast(spark.createDataFrame(table, "chunk_id string, rerank_score double, rerank_rank int")), "chunk_id")

    return rerank
