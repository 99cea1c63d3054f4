"""Upkeep around the store: cascades, the recycle bin, edits, ingest states, jobs, configuration drift."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.config import Settings
from quillmesh.operators import changes, evidence

#: Settings that decide how texts are cut.
CHUNKING = ("chunking_mode", "small_tokens", "medium_tokens", "large_tokens", "overlap_tokens")


def signature(values: dict) -> str:
    """A digest of settings, whatever their order."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def chunking_signature(settings: Settings) -> str:
    return signature({k: v for k, v in asdict(settings).items() if k in CHUNKING})


def after_drift(sources: DataFrame, was: str | None, settings: Settings, has_vectors: bool) -> DataFrame:
    """Sources whose chunks were cut with other settings are pending again."""
    if not has_vectors or was in (None, chunking_signature(settings)):
        return sources
    return sources.withColumn("rag_status", F.when(F.col("exists_status") == "active", "pending").otherwise(F.col("rag_status")))


# ---- cascades: each takes bindings and gives what is left; weights follow by aggregation


def delete_documents(edge_sources: DataFrame, node_sources: DataFrame, chunks: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """What is left of a store's tables without the sources in ``gone``."""
    raw, bound = changes.delete_sources(edge_sources, gone), changes.delete_sources(node_sources, gone)
    nodes = evidence.node_aggregate(bound)
    return {"edge_sources": raw, "edges": evidence.edge_aggregate(raw), "node_sources": bound, "nodes": nodes, "chunks": changes.delete_sources(chunks, gone)}


def delete_node(edge_sources: DataFrame, node_sources: DataFrame, chunks: DataFrame, node_id: str) -> dict[str, DataFrame]:
    """Without a node: its edges, its bindings, and the sources that bind nothing else."""
    gone = changes.sources_of_node_only(node_sources, node_id)
    raw = edge_sources.filter((F.col("source_node_id") != node_id) & (F.col("target_node_id") != node_id))
    return delete_documents(raw, node_sources.filter(F.col("node_id") != node_id), chunks, gone) | {"deleted_sources": gone}


def delete_relation(edge_sources: DataFrame, edge_id: str) -> dict[str, DataFrame]:
    raw = edge_sources.filter(evidence.edge_key() != edge_id)
    return {"edge_sources": raw, "edges": evidence.edge_aggregate(raw)}


def batch_delete(ids: list, delete: Callable[[object], None], most: int = 1000) -> dict[str, list]:
    """Each id once; failures are reported beside what went well."""
    unique = [*dict.fromkeys(ids)]
    if not unique or len(unique) > most:
        raise ValueError(f"1 to {most} ids are deleted at once")
    out: dict[str, list] = {"deleted": [], "failed": []}
    for x in unique:
        try:
            delete(x)
            out["deleted"].append(x)
        except Exception as why:  # one failure leaves the others
            out["failed"].append({"id": x, "error": str(why)})
    return out


def recycle(sources: DataFrame, gone: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    """``source_id, deleted_at, expires_at`` for the bin."""
    return sources.join(gone.select("source_id"), "source_id", "left_semi").select(
        "source_id", F.lit(now).alias("deleted_at"), F.lit(now + dt.timedelta(days=days)).alias("expires_at")
    )


def edit_content(sources: DataFrame, source_id: str, expected_hash: str, text: str) -> DataFrame:
    """Sources with new content for one, both projections pending; a content that has changed meanwhile raises."""
    row = sources.filter(F.col("source_id") == source_id).select("content_hash").first()
    if row is None or row["content_hash"] != expected_hash:
        raise ValueError("the content has changed meanwhile")
    mine = F.col("source_id") == source_id
    put = lambda c, v: F.when(mine, v).otherwise(F.col(c)).alias(c)
    new = {"content_hash": hashlib.sha256(text.encode()).hexdigest(), "graph_status": "pending", "rag_status": "pending"}
    return sources.select(*[put(c, new[c]) if c in new else c for c in sources.columns])


# ---- ingest states

NEXT = {"pending": {"processing"}, "processing": {"ready", "failed", "pending"}, "failed": {"processing", "pending"}, "ready": {"pending"}}


def pending(sources: DataFrame, mode: str, retry_failed: bool = False) -> DataFrame:
    """Live sources that a run in this mode works on."""
    states = ["pending", "failed"] if retry_failed else ["pending"]
    of = {"graph": F.col("graph_status").isin(states), "rag": F.col("rag_status").isin(states)}
    chosen = of["graph"] | of["rag"] if mode == "both" else of[mode]
    return sources.filter((F.col("exists_status") == "active") & chosen)


def settle(sources: DataFrame, projection: str, results: DataFrame) -> DataFrame:
    """Statuses after a run: ``results(source_id, used_hash, error)``.

    A source whose content isn't what the run used is pending again; an error marks it failed.
    """
    status, done = f"{projection}_status", f"{projection}_hash"
    joined = sources.join(results, "source_id", "left")
    moved = F.col("used_hash").isNotNull() & (F.col("used_hash") != F.col("content_hash"))
    state = F.when(F.col("error").isNotNull(), "failed").when(moved, "pending").when(F.col("used_hash").isNotNull(), "ready").otherwise(F.col(status))
    hash_ = F.when(F.col("error").isNull() & (F.col("used_hash") == F.col("content_hash")), F.col("used_hash")).otherwise(F.col(done))
    return joined.select(*[state.alias(c) if c == status else hash_.alias(c) if c == done else c for c in sources.columns])


# ---- jobs


@dataclass
class Job:
    job_id: str
    kind: str
    status: str = "queued"
    progress: float = 0.0
    detail: str = ""
    result: object = None
    error: str | None = None
    events: list[tuple[str, str]] = field(default_factory=list)

    def advance(self, progress: float, detail: str = "") -> None:
        """Progress never falls."""
        self.progress = max(self.progress, min(1.0, progress))
        self.detail = detail or self.detail
        if detail:
            self.events.append(("info", detail))


class JobQueue:
    """Maintenance one after the other; what was running when the process ended counts as failed."""

    def __init__(self, restored: list[Job] | None = None, keep: int = 100):
        self.jobs = {j.job_id: j for j in restored or []}
        self.keep = keep
        for j in self.jobs.values():
            if j.status in ("queued", "running"):
                j.status, j.error = "failed", "the process ended before the job did"

    def run(self, job_id: str, kind: str, work: Callable[[Job], object]) -> Job:
        if any(j.status == "running" for j in self.jobs.values()):
            raise RuntimeError("another job is running")
        job = self.jobs[job_id] = Job(job_id, kind, "running")
        try:
            job.result = work(job)
            job.advance(1.0)
            job.status = "succeeded"
        except Exception as why:  # kept with the job
            job.status, job.error = "failed", f"{type(why).__name__}: {why}"
            job.events.append(("error", job.error))
        finished = [j for j in self.jobs.values() if j.status in ("succeeded", "failed", "cancelled")]
        for old in finished[: max(0, len(finished) - self.keep)]:
            del self.jobs[old.job_id]
        return job


def due(now: dt.datetime, at: str, last: dt.date | None) -> bool:
    """Whether a daily task at HH:MM is to run: once a day, from that time on."""
    hour, minute = map(int, at.split(":"))
    return last != now.date() and (now.hour, now.minute) >= (hour, minute)
