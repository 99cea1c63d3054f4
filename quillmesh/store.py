"""A knowledge store: tables of Parquet parts in one directory, changed in whole transactions.

A commit writes the rows that come and the keys that go, then a manifest that names the parts of
every table (see ``snapshots``).  Readers follow the newest manifest, so they see all of a commit or
nothing; of two commits from the same state one claims the number and the other raises.

An ingest or delete works out anew what its sources touch: their chunks and vectors, the classes of
mentions that they join or part, and the nodes, edges and links of those; all other rows stay where
they are.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.cache import SearchCache
from quillmesh.config import DEFAULTS, Settings
from quillmesh.functions.text import mapped, norm_key_full, norm_keys_full
from quillmesh.operators import changes, chunking, drafts, evidence, graph, listing, modes, organise, planning, retrieval
from quillmesh.plans.classes import updated_classes
from quillmesh.plans.components import durable, tidy
from quillmesh.snapshots import Conflict, Snapshots, Staged
from quillmesh.sources import models

__all__ = ["Conflict", "KnowledgeStore"]

SCHEMAS = {
    "sources": "source_id string, relative_path string, content_hash string, graph_hash string, rag_hash string, graph_status string, rag_status string, exists_status string, error string",
    "chunks": "chunk_id string, source_id string, content string, chunk_index long, granularity string, parent_chunk_id string",
    "vectors": "vec_id string, chunk_id string, source_id string, embedding array<float>, model_name string",
    "mentions": drafts.MENTIONS,
    "terms": "source_id string, mention_id string, term string",
    "classes": "node string, component string",
    "mention_nodes": "source_id string, local_id string, node_id string",
    "nodes": "node_id string, keyword string, summary string, aliases array<string>, tags array<string>, weight double, ref_count long",
    "node_sources": "node_id string, source_id string, evidence_weight double",
    "edge_sources": "source_node_id string, relation string, target_node_id string, source_id string, evidence_weight double",
    "edges": "edge_id string, source_node_id string, relation string, target_node_id string, weight double, support_count long",
    "chunk_nodes": "chunk_id string, node_id string",
    "groups": "group_id string, summary string, node_count long, edge_count long",
    "group_nodes": "group_id string, node_id string",
    "entity_vectors": "node_id string, summary_hash string, vector array<float>, model_name string",
}


#: What names a row, or the rows that are replaced together.
KEYS = {
    **dict.fromkeys(("sources", "chunks", "vectors", "mentions", "terms"), ("source_id",)),
    "classes": ("node",), "mention_nodes": ("source_id", "local_id"), "nodes": ("node_id",), "node_sources": ("node_id", "source_id"),
    "edge_sources": ("source_node_id", "relation", "target_node_id", "source_id"), "edges": ("edge_id",), "chunk_nodes": ("chunk_id", "node_id"),
    "groups": ("group_id",), "group_nodes": ("group_id", "node_id"), "entity_vectors": ("node_id",),
}
#: Signs of texts that a task extracts from, cuts and embeds.
TASK_SIGNS = 8_000_000
#: Signs of all texts up to which Spark alone says how many tasks they are for.
FEW_SIGNS = 1_000_000
#: A term as a node beside mentions, whose ids begin with hexadecimal signs and so come before it.
TERM = "~"


def without(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a that b hasn't, and the other way round; nulls equal nulls."""
    columns = a.columns
    both = a.withColumn("_of", F.lit(1)).unionByName(b.select(*columns).withColumn("_of", F.lit(2)))
    single = durable(both.groupBy(*columns).agg(F.bit_or("_of").alias("_of")).filter("_of < 3"))
    return single.filter("_of = 1").select(*columns), single.filter("_of = 2").select(*columns)


class KnowledgeStore(Snapshots):
    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS, embedder: models.Embedder | None = None, extractor: drafts.Extractor = drafts.rule_extractor, planner: planning.Planner | None = None, cache: SearchCache | None = None, boundaries: Callable[[list[str]], list[tuple[int, int]]] | None = None, reranker: retrieval.Reranker = retrieval.overlap_rerank):
        super().__init__(spark, root, SCHEMAS, KEYS)
        self.settings = settings
        self.embedder = embedder or models.HashEmbedder()
        self.model = getattr(self.embedder, "name", "custom")
        self.extractor, self.planner, self.cache, self.boundaries = extractor, planner, cache, boundaries
        self.reranker = reranker

    # ---- ingest

    def ingest(self, files: DataFrame, mode: str = "both") -> dict[str, int]:
        """Make the store hold just ``files(relative_path, text)``; only sources that have changed are extracted
        and embedded, and only rows that change are written.

        ``mode`` is graph, rag or both.  A failed extraction leaves the source's old graph and
        marks it failed; the next run tries it again.  Texts are read from ``files`` when they are needed, a few times, and never
        written as a whole: each time ``files`` has to give the same rows, and where it can be told that it doesn't, this raises.
        """
        if mode not in ("graph", "rag", "both"):
            raise ValueError("mode is graph, rag or both")
        try:
            return self._ingest(files, mode)
        finally:
            tidy(self.spark)

    def _ingest(self, files: DataFrame, mode: str) -> dict[str, int]:
        base = self.version()
        text = F.coalesce("text", F.lit(""))
        told = durable(files.select(F.sha2(norm_key_full(F.col("relative_path")), 256).alias("source_id"), "relative_path", F.sha2(text, 256).alias("content_hash"), F.length(text).alias("signs")))
        if not told.groupBy("source_id").count().filter("count > 1").isEmpty():
            raise ValueError("two files have the same path identity")
        old = self.read("sources", base)
        was = old.select("source_id", "graph_hash", "rag_hash", "exists_status", F.col("relative_path").alias("_path"), F.col("content_hash").alias("_hash"))
        both = told.join(was, "source_id", "full_outer")
        live = F.col("content_hash").isNotNull()
        plan = durable(
            both.select(
                "source_id", F.coalesce("relative_path", "_path").alias("relative_path"), F.coalesce("content_hash", "_hash").alias("content_hash"), "signs", "graph_hash", "rag_hash", live.alias("live"), (~live & (F.col("exists_status") == "active")).alias("leaves"),
                (live & ~F.col("graph_hash").eqNullSafe(F.col("content_hash")) & F.lit(mode != "rag")).alias("do_graph"),
                (live & ~F.col("rag_hash").eqNullSafe(F.col("content_hash")) & F.lit(mode != "graph")).alias("do_rag"),
            )
        )
        gone = plan.filter("leaves").select("source_id")
        counts = plan.agg(F.count_if("do_graph").alias("graph"), F.count_if("do_rag").alias("rag"), F.count_if("leaves").alias("deleted")).first()

        mentions = durable(drafts.extract_mentions(self._texts(files, plan, "do_graph"), self.extractor, self.settings.section_chars))
        failed = mentions.filter("error IS NOT NULL").select("source_id", "error")
        done = plan.filter("do_graph").select("source_id").join(failed, "source_id", "left_anti")
        replaced = durable(done.unionByName(gone).distinct())
        renewed = durable(plan.filter("do_rag").select("source_id").unionByName(gone).distinct())
        # texts come in ranges of sources, so chunks are written where they stay
        chunks = self.stage("chunks", self._chunks(self._texts(files, plan, "do_rag", ranged=True).select("source_id", "text")))
        tidy(self.spark)  # the texts' shuffle
        try:
            self._ingested(base, plan, failed, replaced, mentions, renewed, chunks)
        finally:
            self.unstage(chunks)
        if counts["deleted"]:
            self._forget()
        return {**counts.asDict(), "failed": failed.count()}

    def _ingested(self, base: int, plan: DataFrame, failed: DataFrame, replaced: DataFrame, mentions: DataFrame, renewed: DataFrame, chunks: Staged) -> None:
        """Embed the chunks, and commit what an ingest has found."""
        vectors = models.embed(chunks.rows.select("chunk_id", "source_id", "content"), "content", self.embedder, keep_text=False)
        # a commit looks at its rows twice, for the ranges of files and to write them; the model sees them once
        vectors = durable(vectors.select(F.concat(F.lit("v:"), "chunk_id").alias("vec_id"), "chunk_id", "source_id", F.col("vector").alias("embedding"), F.lit(self.model).alias("model_name")))
        state = plan.join(failed, "source_id", "left").select(
            "source_id", "relative_path", "content_hash",
            F.when(F.col("do_graph") & F.col("error").isNull(), F.col("content_hash")).when(F.col("live"), F.col("graph_hash")).alias("graph_hash"),
            F.when(F.col("do_rag"), F.col("content_hash")).when(F.col("live"), F.col("rag_hash")).alias("rag_hash"),
            F.when(F.col("live"), "active").otherwise("deleted").alias("exists_status"), "error",
        )
        ready = lambda c: F.when(F.col(c) == F.col("content_hash"), "ready").otherwise("pending")
        sources = durable(state.withColumn("graph_status", F.when(F.col("error").isNotNull(), "failed").otherwise(ready("graph_hash"))).withColumn("rag_status", ready("rag_hash")))
        self._apply(base, sources, replaced, mentions.filter("error IS NULL"), renewed, chunks, vectors)

    def _texts(self, files: DataFrame, plan: DataFrame, what: str, ranged: bool = False) -> DataFrame:
        """``source_id, content_hash, text`` of the sources that are extracted or cut anew, by the plan's column ``what``, dealt
        to tasks of about ``TASK_SIGNS``: in ranges of sources, or, where ``files`` come in enough partitions, as they come.
        """
        n = plan.agg(F.count_if("live").alias("live"), F.count_if(what).alias("sources"), F.sum(F.when(F.col(what), F.col("signs"))).alias("signs")).first()
        text = F.coalesce("text", F.lit("")).alias("text")
        if not n["sources"]:
            return self.spark.createDataFrame([], "source_id string, content_hash string, text string")
        if n["sources"] == n["live"]:
            some = files.filter("relative_path IS NOT NULL").select(F.sha2(norm_key_full(F.col("relative_path")), 256).alias("source_id"), text)
            some = some.select("source_id", F.sha2("text", 256).alias("content_hash"), "text")
        else:
            changed = evidence.small(plan.filter(what).select("source_id", "relative_path", "content_hash"))
            some = files.select("relative_path", text).join(changed, "relative_path")
            same = F.when(F.sha2("text", 256) == F.col("content_hash"), F.col("text")).otherwise(F.raise_error(F.lit("a file isn't what it was when this began")))
            some = some.select("source_id", "content_hash", same.alias("text"))
        parallel = self.spark.sparkContext.defaultParallelism
        tasks = [max(math.ceil(n["signs"] / TASK_SIGNS), parallel)] if n["signs"] > FEW_SIGNS else []
        if ranged:
            return some.repartitionByRange(*tasks, "source_id").sortWithinPartitions("source_id")
        if tasks and files.rdd.getNumPartitions() < parallel:
            return some.repartition(*tasks, "source_id")
        return some

    def _apply(self, base: int, sources: DataFrame, replaced: DataFrame, mentions: DataFrame, renewed: DataFrame, chunks: DataFrame | Staged, vectors: DataFrame) -> int:
        """Commit the state of all ``sources``, the mentions of ``replaced`` ones and the chunks of ``renewed`` ones."""
        sources = sources.select(*self.columns("sources"))
        if not self.manifest(base).get("mentions"):
            terms = self._terms(mentions)
            tables = self._graph(mentions, terms)
            # a commit moves the chunks, and whatever is to be told of them is told before
            links = durable(evidence.chunk_links(chunks.rows if isinstance(chunks, Staged) else chunks, tables["node_sources"], sources))
            return self.commit({"sources": sources, "chunks": chunks, "vectors": vectors, "mentions": mentions, "terms": terms, "chunk_nodes": links, "groups": None, "group_nodes": None, **tables}, base)
        fresh, was = without(sources, self.read("sources", base))
        key = lambda rows: rows.select("source_id")
        stated = durable(key(fresh).unionByName(key(was)).distinct())
        changes = {"sources": (fresh, stated), "chunks": (chunks, renewed), "vectors": (vectors, renewed)}
        near = stated.unionByName(key(renewed))
        if not replaced.isEmpty():
            graph_changes, moved = self._graph_changes(base, replaced, durable(mentions.select(*self.columns("mentions"))))
            changes, near = changes | graph_changes, near.unionByName(moved)
        near = durable(near.distinct())
        if near.isEmpty():
            return base
        now = lambda name: self._now(name, base, changes)
        new_links = evidence.chunk_links(now("chunks").join(near, "source_id", "left_semi"), now("node_sources").join(near, "source_id", "left_semi"), sources)
        of = self.read_keys("chunks", near, base).select("chunk_id").unionByName(now("chunks").join(near, "source_id", "left_semi").select("chunk_id")).distinct()
        fresh, was = without(new_links, self.read_keys("chunk_nodes", durable(of), base))
        changes["chunk_nodes"] = (fresh, was.unionByName(fresh))
        return self.commit({"groups": None, "group_nodes": None}, base, changes)

    def _now(self, name: str, base: int, changes: dict[str, tuple[DataFrame | Staged, DataFrame]]) -> DataFrame:
        """A table as it will be after the changes."""
        held = self.read(name, base)
        if name not in changes:
            return held
        fresh, gone = changes[name]
        fresh = fresh.rows if isinstance(fresh, Staged) else fresh
        keys = list(KEYS[name])
        return held.join(gone.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(*self.columns(name)))

    def _chunks(self, rag: DataFrame) -> DataFrame:
        s = self.settings
        if s.chunking_mode == "fixed":
            cut = chunking.fixed_chunks(rag, s.medium_tokens, s.overlap_tokens, "source_id")
            return cut.select(F.concat_ws(":", "source_id", "token_start").alias("chunk_id"), "source_id", "content", "chunk_index", F.lit("medium").alias("granularity"), F.lit(None).cast("string").alias("parent_chunk_id"))
        model = self.boundaries if s.chunking_mode == "semantic_hierarchical" else None
        tree = chunking.semantic_hierarchy(rag, model, (s.small_tokens, s.medium_tokens, s.large_tokens), s.overlap_tokens, "source_id", most=s.section_chars)
        own = chunking.chunk_id(F.col("source_id"), F.col("granularity"), F.col("token_start"))
        up = F.when(F.col("parent_start").isNotNull(), chunking.chunk_id(F.col("source_id"), F.col("parent_granularity"), F.col("parent_start")))
        return tree.select(own.alias("chunk_id"), "source_id", "content", "chunk_index", "granularity", up.alias("parent_chunk_id"))

    def _terms(self, mentions: DataFrame) -> DataFrame:
        """``source_id, mention_id, term`` of the entities among the mentions."""
        entity = mentions.filter("relation IS NULL").withColumn("node_id", F.concat_ws("#", "source_id", "local_id"))
        of = evidence.terms(entity, norm_key_full).withColumnRenamed("node_id", "mention_id")
        return durable(of.select(F.substring_index("mention_id", "#", 1).alias("source_id"), "mention_id", "term"))

    def _graph(self, mentions: DataFrame, terms: DataFrame) -> dict[str, DataFrame]:
        """Nodes are the classes of mentions that share terms, all sources at once; weights derive from evidence."""
        entity = mentions.filter("relation IS NULL").select(F.concat_ws("#", "source_id", "local_id").alias("node_id"))
        ends = terms.select(F.col("mention_id").alias("source_node_id"), F.concat(F.lit(TERM), "term").alias("target_node_id"))
        nodes = entity.unionByName(ends.select(F.col("target_node_id").alias("node_id"))).distinct()
        classes = durable(organise.components(nodes, ends).withColumnRenamed("node_id", "node"))
        to = durable(self._nodes_of(classes))
        of = durable(self._told(mentions, to))
        node_sources = self._bound_nodes(of)
        raw = durable(self._relations(mentions, to))
        return {"classes": classes, "mention_nodes": to, "nodes": self._described(of, node_sources), "node_sources": node_sources, "edge_sources": evidence.edge_bindings(raw), "edges": evidence.edge_aggregate(raw)}

    def _nodes_of(self, classes: DataFrame) -> DataFrame:
        """``source_id, local_id, node_id`` of the mentions among the members of classes."""
        mention = classes.filter(~F.col("node").startswith(TERM))
        local = F.expr("substring(node, instr(node, '#') + 1)")
        return mention.select(F.substring_index("node", "#", 1).alias("source_id"), local.alias("local_id"), F.concat(F.lit("n:"), F.substring(F.sha2("component", 256), 1, 20)).alias("node_id"))

    def _told(self, mentions: DataFrame, to: DataFrame) -> DataFrame:
        """Entities with the node they are mentions of."""
        return mentions.filter("relation IS NULL").join(to, ["source_id", "local_id"]).withColumn("mention_id", F.concat_ws("#", "source_id", "local_id"))

    def _bound_nodes(self, told: DataFrame) -> DataFrame:
        return told.groupBy("node_id", "source_id").agg(F.max("weight").alias("evidence_weight"))

    def _described(self, told: DataFrame, node_sources: DataFrame) -> DataFrame:
        best = F.struct("weight", "mention_id")
        # names and tags a node is told with, each once before they meet
        many = lambda c: told.select("node_id", F.explode(c).alias("x")).distinct().groupBy("node_id").agg(F.array_sort(F.collect_list("x")).alias(c))
        named = told.withColumn("terms", F.array_append("aliases", F.col("keyword")))
        terms = named.select("node_id", F.explode("terms").alias("x")).distinct().groupBy("node_id").agg(F.array_sort(F.collect_list("x")).alias("terms"))
        described = told.groupBy("node_id").agg(F.max_by("keyword", best).alias("keyword"), F.max_by("summary", F.struct(F.length("summary"), "mention_id")).alias("summary"))
        described = described.join(terms, "node_id").join(many("tags"), "node_id", "left").withColumn("tags", F.coalesce("tags", F.expr("cast(array() AS array<string>)")))
        whole = described.join(evidence.node_aggregate(node_sources), "node_id").withColumn("aliases", F.array_remove("terms", F.col("keyword")))
        return whole.select(*self.columns("nodes"))

    def _relations(self, mentions: DataFrame, to: DataFrame) -> DataFrame:
        """Raw evidence of edges: relations between the nodes that their ends are mentions of."""
        a = to.select("source_id", "local_id", F.col("node_id").alias("source_node_id"))
        b = to.select("source_id", F.col("local_id").alias("target_id"), F.col("node_id").alias("target_node_id"))
        raw = mentions.filter("relation IS NOT NULL").join(a, ["source_id", "local_id"]).join(b, ["source_id", "target_id"]).filter("source_node_id != target_node_id")
        return raw.select("source_node_id", "relation", "target_node_id", "source_id", F.col("weight").alias("evidence_weight"))

    def _graph_changes(self, base: int, replaced: DataFrame, mentions: DataFrame) -> tuple[dict[str, tuple[DataFrame, DataFrame]], DataFrame]:
        """What the graph's tables gain and lose as the mentions of ``replaced`` sources become ``mentions``; and
        the sources that any of it touches."""
        ids = durable(replaced.select("source_id").distinct())
        old, old_terms = durable(self.read_keys("mentions", ids, base)), durable(self.read_keys("terms", ids, base))
        terms = self._terms(mentions)
        changes = {"mentions": (mentions, ids), "terms": (terms, ids)}
        # classes of mentions over the terms they share
        edge = lambda t: t.select(F.col("mention_id").alias("a"), F.concat(F.lit(TERM), "term").alias("b"))
        entity = lambda m: m.filter("relation IS NULL").select(F.concat_ws("#", "source_id", "local_id").alias("node"))
        term = lambda e: e.select(F.col("b").alias("node")).distinct()
        added, removed = without(edge(terms), edge(old_terms))
        born, gone = without(entity(mentions), entity(old))
        stay = durable(self.read("terms", base).join(ids, "source_id", "left_anti").transform(edge).unionByName(edge(old_terms).join(removed, ["a", "b"], "left_anti")))
        classes = self.read("classes", base)
        lost_terms = term(removed).join(term(stay).unionByName(term(added)), "node", "left_anti")
        new_terms = term(added).join(classes, "node", "left_anti")
        changed, dropped = updated_classes(classes, stay, removed, added, gone.unionByName(lost_terms), born.unionByName(new_terms))
        changes["classes"] = (changed, changed.select("node").unionByName(dropped))
        to, lost = self._nodes_of(changed), self._nodes_of(dropped.withColumn("component", F.lit(""))).select("source_id", "local_id")
        to = durable(to)
        changes["mention_nodes"] = (to, to.select("source_id", "local_id").unionByName(lost))
        # everything that the sources of moved and replaced mentions say is told anew and compared
        near = durable(ids.unionByName(to.select("source_id")).distinct())
        mentions_now = durable(self._now("mentions", base, changes).join(near, "source_id", "left_semi"))
        nodes_now = durable(self._now("mention_nodes", base, changes).join(near, "source_id", "left_semi"))
        was = self.read("node_sources", base).join(near, "source_id", "left_semi")
        told_before = durable(self.read_keys("mention_nodes", near, base).select("node_id").distinct())
        bound, unbound = without(self._bound_nodes(self._told(mentions_now, nodes_now)), was)
        pair = lambda rows: rows.select("node_id", "source_id")
        changes["node_sources"] = (bound, pair(bound).unionByName(pair(unbound)))
        touched = durable(told_before.unionByName(nodes_now.select("node_id")).distinct())
        of = self._now("mention_nodes", base, changes).join(touched, "node_id", "left_semi")
        described = self._described(durable(self._told(self._now("mentions", base, changes), of)), self._now("node_sources", base, changes).join(touched, "node_id", "left_semi"))
        fresh, stale = without(described, self.read_keys("nodes", touched, base))
        changes["nodes"] = (fresh, fresh.select("node_id").unionByName(stale.select("node_id")))
        said = evidence.edge_bindings(self._relations(mentions_now, nodes_now)).select(*self.columns("edge_sources"))
        bound, unbound = without(said, self.read("edge_sources", base).join(near, "source_id", "left_semi"))
        keys = list(KEYS["edge_sources"])
        changes["edge_sources"] = (bound, bound.select(*keys).unionByName(unbound.select(*keys)))
        triples = durable(bound.unionByName(unbound).select(*keys[:3]).distinct())
        edges = evidence.edge_aggregate(self._now("edge_sources", base, changes).join(triples, keys[:3], "left_semi"))
        changes["edges"] = (edges, triples.select(evidence.edge_key().alias("edge_id")))
        return changes, near

    # ---- deletes: what is left of the mentions yields the graph anew

    def delete_sources(self, ids: list[str]) -> int:
        """Without these sources' chunks and evidence; returns how many there were.  Unknown ids are passed over."""
        base = self.version()
        return self._delete(base, self.spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], "source_id string"), self.read("mentions", base))

    def delete_node(self, node_id: str) -> int:
        """Without a node, its relations, and the sources that bind nothing else; returns how many sources went.

        It stays away until a source that names it changes.
        """
        base = self.version()
        of = self.read("mention_nodes", base).filter(F.col("node_id") == node_id).select("source_id", "local_id")
        if of.isEmpty():
            raise KeyError(node_id)
        # an entity, or a relation at either end, by the name it has in its source
        left = self.read("mentions", base).join(of, ["source_id", "local_id"], "left_anti").join(of.withColumnRenamed("local_id", "target_id"), ["source_id", "target_id"], "left_anti")
        return self._delete(base, changes.sources_of_node_only(self.read("node_sources", base), node_id), left)

    def delete_relation(self, edge_id: str) -> None:
        """Without a relation, whichever sources tell it; its nodes stay."""
        base = self.version()
        edge = self.read("edges", base).filter(F.col("edge_id") == edge_id).first()
        if edge is None:
            raise KeyError(edge_id)
        to = self.read("mention_nodes", base)
        a = to.filter(F.col("node_id") == edge["source_node_id"]).select("source_id", "local_id")
        b = to.filter(F.col("node_id") == edge["target_node_id"]).select("source_id", F.col("local_id").alias("target_id"))
        told = a.join(b, "source_id").withColumn("relation", F.lit(edge["relation"]))
        none = self.spark.createDataFrame([], "source_id string")
        self._delete(base, none, self.read("mentions", base).join(told, ["source_id", "local_id", "relation", "target_id"], "left_anti"))

    def _delete(self, base: int, gone: DataFrame, mentions: DataFrame) -> int:
        """Without the sources ``gone``; of others ``mentions`` has what is left of their mentions."""
        was = self.read("sources", base)
        gone = durable(was.filter("exists_status = 'active'").select("source_id").join(gone, "source_id", "left_semi"))
        left = durable(mentions.join(gone, "source_id", "left_anti"))
        _, lost = without(left, self.read("mentions", base))
        replaced = durable(lost.select("source_id").unionByName(gone).distinct())
        new = {"graph_hash": F.lit(None), "rag_hash": F.lit(None), "graph_status": F.lit("pending"), "rag_status": F.lit("pending"), "exists_status": F.lit("deleted"), "error": F.lit(None)}
        marked = was.join(gone.withColumn("_gone", F.lit(True)), "source_id", "left")
        sources = durable(marked.select(*[F.when(F.col("_gone"), new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in was.columns]))
        self._apply(base, sources, replaced, left.join(replaced, "source_id", "left_semi"), gone, self.empty("chunks"), self.empty("vectors"))
        self._forget()
        return gone.count()

    def _forget(self) -> None:
        """Cached results may hold deleted text."""
        if self.cache is not None:
            self.cache.clear()

    def rebuild(self, files: DataFrame) -> int:
        """Everything anew: built beside the old tables, validated, then committed as one version."""
        shadow = KnowledgeStore(self.spark, f"{self.root}/shadow-{uuid.uuid4().hex}", self.settings, self.embedder, self.extractor, self.planner, boundaries=self.boundaries)
        shadow.ingest(files)
        bad = shadow.violations()
        if not bad.isEmpty():
            raise ValueError(f"the rebuilt store isn't sound: {bad.first()}")
        number = self.adopt(shadow)
        self._forget()
        return number

    def violations(self) -> DataFrame:
        """``kind, id``: vectors without chunk, chunks without vector or source, edges without node, ready sources without hash."""
        r = self.read
        live = r("sources").filter("exists_status = 'active'")

        def bad(kind: str, rows: DataFrame, key: str) -> DataFrame:
            return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))

        node = r("nodes").select("node_id")
        out = [
            bad("vector_without_chunk", r("vectors").join(r("chunks").select("chunk_id"), "chunk_id", "left_anti"), "vec_id"),
            bad("chunk_without_vector", r("chunks").join(r("vectors").select("chunk_id"), "chunk_id", "left_anti"), "chunk_id"),
            bad("chunk_without_source", r("chunks").join(live.select("source_id"), "source_id", "left_anti"), "chunk_id"),
            bad("edge_without_source", r("edges").join(node.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_anti"), "edge_id"),
            bad("edge_without_target", r("edges").join(node.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_anti"), "edge_id"),
            bad("hash_mismatch", live.filter("rag_status = 'ready' AND rag_hash != content_hash"), "source_id"),
            bad("model_mismatch", r("vectors").filter(F.col("model_name") != self.model), "vec_id"),
        ]
        total = out[0]
        for rows in out[1:]:
            total = total.unionByName(rows)
        return total

    # ---- upkeep

    def summarise(self, write: Callable[[str], str] | None = None) -> int:
        """Communities of three nodes and three hops or more, with a summary each; returns their number."""
        base = self.version()
        nodes, edges = self.read("nodes"), self.read("edges")
        members = organise.components(nodes, edges)
        deep = organise.qualified(members, edges)
        inside = durable(members.join(deep.select("component"), "component", "left_semi"))
        told = organise.summary_input(inside, nodes)
        size = organise.community_stats(inside, edges).join(told, "component", "left")
        summary = F.coalesce("names", F.lit(""))
        if write is not None:
            summary = mapped(write)(summary)
        groups = durable(size.select(F.col("component").alias("group_id"), summary.alias("summary"), "node_count", "edge_count"))
        self.commit({"groups": groups, "group_nodes": inside.select(F.col("component").alias("group_id"), "node_id")}, base)
        self._forget()
        return groups.count()

    def sync_entity_vectors(self) -> int:
        """Embed the nodes whose summary, model or length isn't the vector's; returns how many were."""
        base = self.version()
        text = F.concat_ws(": ", "keyword", "summary")
        objects = self.read("nodes").select(F.col("node_id").alias("id"), text.alias("summary"))
        held = self.read("entity_vectors").select(F.col("node_id").alias("id"), "summary_hash", "vector", "model_name")
        size = len(self.embedder(["x"])[0])
        stale = retrieval.stale_rows(objects, held, size, self.model)
        made = durable(models.embed(stale.join(objects, "id"), "summary", self.embedder, size).select("id", "summary_hash", "vector", F.lit(self.model).alias("model_name")))
        n = made.count()
        drop = retrieval.prunable_vectors(objects, held, size, self.model)
        if n or not drop.isEmpty():
            gone = drop.select("id").unionByName(made.select("id")).withColumnRenamed("id", "node_id")
            self.commit({}, base, {"entity_vectors": (made.withColumnRenamed("id", "node_id"), gone)})
        return n

    def revision(self) -> str:
        return listing.revision([(n, self.read(n)) for n in sorted(self.manifest())])

    # ---- queries

    def _plan(self, query: str) -> planning.QueryPlan:
        return planning.plan_query(query, self.planner, self.settings)

    def _variants(self, plan: planning.QueryPlan) -> list[tuple[int, planning.Variant, list[float]]]:
        vectors = self.embedder([v.text for v in plan.variants])
        rows = [(i, v, x) for i, (v, x) in enumerate(zip(plan.variants, vectors, strict=True))]
        frame = self.spark.createDataFrame([(i, x) for i, _, x in rows], "idx int, vector array<double>")
        near = {r.idx for r in retrieval.keep_variants(frame, self.settings.drift_threshold).select("idx").collect()}
        return [r for r in rows if r[0] in near]

    def _scores(self, base: DataFrame, rows: list, k: int, key: str, vector: str) -> DataFrame:
        queries = self.spark.createDataFrame([(i, x) for i, _, x in rows], "query_id int, vector array<double>")
        hits = retrieval.top_inner_product(base, queries, k, key, vector)
        weight = F.lit(None).cast("double")
        for i, v, _ in rows:
            weight = F.when(F.col("query_id") == i, v.weight).otherwise(weight)
        return retrieval.fuse(hits, weight, len(rows), self.settings.rrf_k)

    def graph(self, query: str, depth: int = 3, direction: str = "both", threshold: float | None = None) -> dict[str, DataFrame]:
        if depth > self.settings.max_query_depth:
            raise ValueError(f"depth is at most {self.settings.max_query_depth}")
        plan, nodes, edges = self._plan(query), self.read("nodes"), self.read("edges")
        entities = planning.entities_of(plan)
        if not plan.entities and self.planner is None:
            terms = self.spark.createDataFrame([(query,)], "q string").select(planning.rule_terms(F.col("q"))).first()[0]
            entities = [planning.Entity(t, t) for t in dict.fromkeys(terms)] or entities
        least = self.settings.default_confidence if threshold is None else threshold
        hit = durable(graph.match_nodes(planning.entity_frame(self.spark, entities[: self.settings.max_entities]), nodes, least, key=norm_key_full, keys=norm_keys_full))
        order = F.round(F.col("score") * -1e6).cast("long")  # best first, then by id
        visited, touched = graph.expand(edges, hit.select("node_id", order.alias("ord")), depth, direction)
        near = edges.join(touched.select("edge_id"), "edge_id", "left_semi")
        return {
            "nodes": hit, "expanded": visited, "edges": near, "relations": graph.relation_text(near, nodes), "paths": graph.paths(visited, edges, nodes, self.settings.path_limit),
            "groups": graph.groups_of(self.read("group_nodes"), visited),
        }

    def rag(self, query: str, top_k: int | None = None, threshold: float | None = None, anchors: DataFrame | None = None) -> DataFrame:
        s, plan = self.settings, self._plan(query)
        rows = self._variants(plan)
        top = top_k or s.top_k
        pool = max(top, s.candidate_pool)
        fused = self._scores(self.read("vectors"), rows, max(3 * top, pool), "vec_id", "embedding")
        chunks = retrieval.with_family(self.read("chunks"))
        found = retrieval.best_per_chunk(fused, self.read("vectors").select("vec_id", "chunk_id"), chunks)
        if anchors is not None:
            found = modes.anchored(found, self.read("chunk_nodes"), anchors, s.anchor_factor)
        found = retrieval.with_context(found, chunks)
        limit = max(top, s.rerank_top_n, pool if len(rows) > 1 else 0)
        asked = [(v.text, v.weight) for _, v, _ in rows]
        got = retrieval.rag_query(durable(found), plan.variants[0].text, top, pool, limit, threshold, asked, s.rescue_count, s.similarity_threshold, self.reranker)
        return got.join(self.read("sources").select("source_id", "relative_path"), "source_id")

    def hybrid(self, query: str, top_k: int | None = None, depth: int = 3) -> dict[str, DataFrame]:
        found = self.graph(query, depth)
        rows = self._variants(self._plan(query))
        scores = self._scores(self.read("entity_vectors"), rows, self.settings.candidate_pool, "node_id", "vector")
        entities = modes.weighted_search(scores, self.read("nodes"), self.settings.entity_weight, "node_id", self.settings.entity_top_k)
        return {**found, "passages": self.rag(query, top_k, anchors=found["expanded"]), "entities": entities}

    def answer(self, query: str, chat: Callable[[str, list], str] | None = None) -> str:
        found = self.hybrid(query)
        nodes = self.read("nodes").join(found["expanded"].select("node_id"), "node_id", "left_semi")
        groups = self.read("groups").join(found["groups"], "group_id", "left_semi")
        context = modes.answer_context(nodes, found["relations"], found["paths"], groups, found["passages"], found["entities"], groups)
        return modes.answer(context, query, chat)

    def ask(self, mode: str, query: str, **params) -> tuple[list[dict] | str, bool]:
        """What ``rag``, ``key_entities`` or ``answer`` gives, as plain values in order, and whether the cache held it.

        A result holds for the store's version, its settings and models by name, and ``params``; with a
        parameter that is a function it is computed each time.
        """
        if mode not in ("rag", "key_entities", "answer"):
            raise ValueError("mode is rag, key_entities or answer")

        def plain() -> list[dict] | str:
            found = getattr(self, mode)(query, **params)
            if isinstance(found, str):
                return found
            rows = [r.asDict(recursive=True) for r in found.collect()]  # as many as were asked for at most
            if "rerank_rank" in found.columns:
                rows.sort(key=lambda r: r["rerank_rank"])
            return json.loads(json.dumps(rows, default=str))

        if self.cache is None or any(callable(p) or isinstance(p, DataFrame) for p in params.values()):
            return plain(), False
        named = lambda f: f and getattr(f, "name", getattr(f, "__qualname__", type(f).__qualname__))
        config = {**asdict(self.settings), "model": self.model, "planner": named(self.planner), "reranker": named(self.reranker)}
        return self.cache.run(mode, query, lambda: str(self.version()), plain, config, params)

    def relation(self, edge_id: str) -> DataFrame:
        """A relation's detail with the evidence of each source."""
        edges = self.read("edges").filter(F.col("edge_id") == edge_id)
        found = graph.relation_detail(edges, self.read("edge_sources"), self.read("nodes"))
        return found.join(self.read("sources").select("source_id", "relative_path"), "source_id", "left")

    def key_entities(self, query: str, top_k: int = 10) -> DataFrame:
        """Global mode: the communities nearest to the query by their summaries, and their key entities."""
        rows = self._variants(self._plan(query))
        vectors = models.embed(self.read("groups").select("group_id", "summary"), "summary", self.embedder)
        scores = self._scores(vectors, rows, self.settings.community_top_k, "group_id", "vector").orderBy(F.desc("score"), "id").limit(self.settings.community_top_k)
        members = self.read("group_nodes").join(scores.select(F.col("id").alias("group_id")), "group_id", "left_semi")
        return modes.key_entities(members, self.read("nodes"), top_k)
