"""Queries over change data, listings, caches and integrity."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import changes, evidence, listing
from quillmesh.sources.tables import SQL_EVIDENCE, SQL_NODES, edge_evidence, node_names, sources, table
from quillmesh.streaming import sync


def documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows, total, pages = listing.page(docs, [F.desc("n_chars"), "doc_id"], 3, 20)
    return rows.select("doc_id", "source", "n_chars", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


def viz_nodes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of nodes by name, with the sources that bind each."""
    bindings = evidence.node_bindings(edge_evidence(spark, sf_dir))
    rows, _, _ = listing.page(node_names(spark, sf_dir).select("node_id", "keyword"), [F.lower("keyword"), "node_id"], 2, 50)
    return listing.with_members(rows, bindings, "node_id", "source_id", "source_ids").select("node_id", "keyword", F.array_join("source_ids", ",").alias("source_ids"))


def graph_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.revision([("nodes", node_names(spark, sf_dir)), ("edges", edge_evidence(spark, sf_dir))])
    return spark.createDataFrame([(found,)], "revision string")


def cache_prune_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries: keep 4,000 entries and 60 % of the bytes."""
    entries = _entries(spark, sf_dir)
    total = entries.agg(F.sum("result_size")).first()[0] or 0
    return listing.prune_lru(entries, 4000, total * 6 // 10)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("cache_key"), F.round(F.col("value") * 100).cast("long").alias("result_size"),
        F.when(F.col("event_type") == "click", F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("last_hit_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.col("ts").alias("created_at"),
    )


def jobs_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("running").alias("status"), F.col("o_orderdate").alias("finished_at"))
    return listing.keep_newest(jobs, 100, "job_id", "finished_at")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.status_counters(sources(spark, sf_dir))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", listing.cache_key(F.lit("rag"), F.col("text"), F.lit("s"), F.lit("c"), F.lit("{}")).alias("cache_key"))


def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a registry of files, scanned again with some gone, changed and new."""
    o = table(spark, sf_dir, "orders")
    known = o.filter("o_orderkey % 10 != 0").select(
        F.col("o_orderkey").alias("path_hash"), F.col("o_orderpriority").alias("content_hash"), F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("active").alias("exists_status")
    )
    found = o.filter("o_orderkey % 7 != 0").select(
        F.col("o_orderkey").alias("path_hash"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("x")).otherwise(F.col("o_orderpriority")).alias("content_hash")
    )
    return changes.scan_difference(known, found)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A state out of each user's first event by number, and a batch of each user's last."""
    e = _log(spark, sf_dir)
    row = F.struct("event_id", "ts", "event_type", "value", "props")
    ends = e.groupBy("user_id").agg(F.min_by(row, "event_id").alias("a"), F.max_by(row, "event_id").alias("b"))
    uri = F.concat(F.lit("user://"), F.col("user_id").cast("string"))
    content = lambda x: F.concat(F.col(f"{x}.event_type"), F.lit("\n"))
    same = F.col("user_id") % 3 == 0
    state = ends.select(
        uri.alias("source_uri"), (F.col("user_id") % 4).cast("string").alias("revision"), F.col("a.ts").alias("updated_at"), F.sha2(content("a"), 256).alias("content_hash"),
        F.col("a.props").alias("metadata"), F.when(F.col("a.event_type") == "error", "deleted").otherwise("active").alias("exists_status"),
    ).filter("source_uri NOT LIKE '%7'")
    batch = ends.select(
        uri.alias("source_uri"), F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 4).otherwise(9).cast("string").alias("revision"),
        F.when(same, F.col("a.ts")).when(F.col("user_id") % 5 == 0, F.col("a.ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("b.ts")).alias("updated_at"),
        F.when(same, F.col("a.event_type")).otherwise(F.col("b.event_type")).alias("content"),
        F.when(same, F.col("a.props")).otherwise(F.col("b.props")).alias("metadata"), (F.col("b.event_type") == "error").alias("deleted"),
    )
    return state, batch


def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcome = changes.synchronise(*_batches(spark, sf_dir))
    return outcome


def cdc_merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = changes.synchronise(*_batches(spark, sf_dir))
    return after.select("source_uri", "revision", "content_hash", "exists_status")


def cdc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest_state(_log(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type") == "error").select("user_id", "revision", "exists_status", "changes")


def cdc_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.arrival_outcomes(_log(spark, sf_dir), "user_id", "event_id", "ts")
    return found.groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


def delete_document_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the deletion of every third source."""
    raw = edge_evidence(spark, sf_dir)
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source_id"))
    left = evidence.edge_aggregate(changes.delete_sources(raw, gone))
    return left.select("edge_id", F.round("weight", 6).alias("weight"), "support_count")


def delete_node_isolated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources bound to one supplier alone."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("node_id"))
    return changes.sources_of_node_only(lines, "supplier:5")


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    known = o.filter("o_orderkey % 11 != 0").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("content_hash"))
    bound = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("source_id"), F.when(F.col("l_orderkey") % 5 == 0, F.lit("old")).otherwise(F.col("o_orderpriority")).alias("content_hash")
    )
    return changes.integrity_violations(known, bound)


def managed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "pages")
    return docs.select("page_id", changes.managed_path(F.lit("web"), F.col("url"), F.col("url")).alias("path"), changes.import_name(F.lit("page"), F.col("url")).alias("name"))


def file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    old = c.select(name(F.col("c_custkey")).alias("original"), name(F.col("c_custkey") + 10).alias("markdown"))
    new = c.filter("c_custkey % 5 = 0").select(name(F.col("c_custkey")).alias("original"), name(F.col("c_custkey") + 12).alias("markdown"))
    return changes.file_map_upsert(old, new)


def stream_cdc_foreachbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events streamed into a state in a few micro-batches; in whatever order these come, the newest stays."""
    from quillmesh.plans.components import shared_folder

    root = f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}"
    e = _log(spark, sf_dir).select(
        F.concat(F.lit("user://"), F.col("user_id").cast("string")).alias("source_uri"), F.col("event_id").cast("string").alias("revision"), F.col("ts").alias("updated_at"),
        F.col("event_type").alias("content"), F.col("props").alias("metadata"), F.lit(False).alias("deleted"), (F.col("event_id") % 3).alias("part"),
    )
    e.repartition(3, "part").drop("part").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    sync.stream_sync(stream, f"{root}/state", f"{root}/log").awaitTermination()
    return sync.SnapshotState(spark, f"{root}/state").read().select("source_uri", "revision", "exists_status")


def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into a store; what its tables hold after it, and after an eighth of them has gone."""
    from quillmesh.plans.components import shared_folder
    from quillmesh.store import KnowledgeStore

    store = KnowledgeStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("relative_path"), "text", "doc_id")
    out = []
    for step, rows in ((1, files), (2, files.filter("doc_id % 8 != 0"))):
        store.ingest(rows)
        out += [(step, name, store.read(name).count()) for name in ("chunks", "vectors", "nodes", "edges", "node_sources")]
        out.append((step, "active", store.read("sources").filter("exists_status = 'active'").count()))
    store.drop()
    return spark.createDataFrame(out, "step int, name string, rows long")


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as kept results: all stored, clicks and then views stored anew for later states, what has expired pruned."""
    from quillmesh.operators.results import ResultTable
    from quillmesh.plans.components import durable, shared_folder

    now = [dt.datetime(2024, 1, 1)]
    kept = ResultTable(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}", most=2**62, most_bytes=2**62, clock=lambda: now[0])
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.lit("rag").alias("mode"), F.col("event_type").alias("query"), F.col("props").alias("body"))
    for day, rows in ((1, e), (2, e.filter("query = 'click'")), (3, e.filter("query = 'view'"))):
        now[0] = dt.datetime(2024, 1, day)
        kept.put_many(rows.withColumn("state", F.lit(f"s{day}")))
    now[0] = dt.datetime(2024, 1, 8, 12)
    kept.prune()
    found = durable(kept.entries("s3").select("key", "query", "state", "is_stale", "result_size", F.dayofmonth("created_at").alias("created"), F.dayofmonth("updated_at").alias("updated")))
    kept.table.drop()
    return found


QUERIES = {
    f.__name__: f
    for f in (
        documents_page, viz_nodes_page, graph_revision, cache_prune_lru, jobs_keep_newest, status_counts, cache_keys, scan_diff, cdc_classify, cdc_merged_state,
        cdc_latest_state, cdc_arrival, delete_document_cascade, delete_node_isolated_sources, integrity_violations, managed_paths, file_map, stream_cdc_foreachbatch,
        store_ingest, result_table,
    )
}

_BATCH = """ends AS (
    SELECT user_id, arg_min(event_type, event_id) AS at_, arg_min(ts, event_id) AS ats, arg_min(props, event_id) AS ap,
           arg_max(event_type, event_id) AS bt, arg_max(ts, event_id) AS bts, arg_max(props, event_id) AS bp FROM events GROUP BY user_id
), state AS (
    SELECT 'user://' || user_id AS source_uri, (user_id % 4)::VARCHAR AS revision, ats AS updated_at, sha256(at_ || chr(10)) AS content_hash, ap AS metadata,
           CASE WHEN at_ = 'error' THEN 'deleted' ELSE 'active' END AS exists_status FROM ends WHERE user_id::VARCHAR NOT LIKE '%7'
), batch AS (
    SELECT 'user://' || user_id AS source_uri, CASE WHEN user_id % 2 = 0 THEN (user_id % 4)::VARCHAR ELSE '9' END AS revision,
           CASE WHEN user_id % 3 = 0 THEN ats WHEN user_id % 5 = 0 THEN ats - INTERVAL 1 DAY ELSE bts END AS updated_at,
           sha256(CASE WHEN user_id % 3 = 0 THEN at_ ELSE bt END || chr(10)) AS content_hash, CASE WHEN user_id % 3 = 0 THEN ap ELSE bp END AS metadata, bt = 'error' AS deleted FROM ends
), told AS (
    SELECT b.*, s.revision AS r0, s.content_hash AS h0, s.exists_status AS x0, CASE
        WHEN s.source_uri IS NULL THEN CASE WHEN deleted THEN 'unchanged' ELSE 'created' END
        WHEN b.updated_at < s.updated_at THEN 'stale'
        WHEN NOT deleted AND s.exists_status = 'active' AND b.revision = s.revision AND b.content_hash <> s.content_hash THEN 'conflict'
        WHEN deleted AND s.exists_status = 'active' THEN 'deleted'
        WHEN NOT deleted AND (s.exists_status <> 'active' OR b.content_hash <> s.content_hash) THEN 'updated'
        WHEN b.updated_at <> s.updated_at OR b.revision <> s.revision OR b.metadata <> s.metadata THEN 'metadata_updated'
        ELSE 'unchanged' END AS outcome
    FROM batch b LEFT JOIN state s ON b.source_uri = s.source_uri
)"""
_TAKEN = "outcome IN ('created', 'updated', 'metadata_updated', 'deleted')"
ORACLE = {
    "result_table": """
        SELECT event_id::VARCHAR AS "key", event_type AS query, CASE event_type WHEN 'click' THEN 's2' ELSE 's3' END AS state,
               event_type = 'click' AS is_stale, octet_length(props::BLOB)::BIGINT AS result_size, 1 AS created,
               CASE event_type WHEN 'click' THEN 2 ELSE 3 END AS updated
        FROM events WHERE event_type IN ('click', 'view')
    """,
    "documents_page": """
        SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents) AS total, (SELECT ceil(count(*) / 20.0)::BIGINT FROM documents) AS pages
        FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40
    """,
    "viz_nodes_page": f"""
        WITH {SQL_NODES}, {SQL_EVIDENCE}, bound AS (
            SELECT source_node_id AS node_id, source_id FROM evidence UNION SELECT target_node_id, source_id FROM evidence
        ), page AS (SELECT node_id, keyword FROM nodes ORDER BY lower(keyword), node_id LIMIT 50 OFFSET 50)
        SELECT node_id, any_value(keyword) AS keyword, coalesce(string_agg(source_id::VARCHAR, ',' ORDER BY source_id), '') AS source_ids
        FROM page LEFT JOIN bound USING (node_id) GROUP BY node_id
    """,
    "cache_prune_lru": """
        WITH e AS (
            SELECT event_id AS cache_key, round(value * 100)::BIGINT AS size, CASE WHEN event_type = 'click' THEN ts + INTERVAL 1 DAY ELSE ts END AS at_ FROM events
        ), s AS (
            SELECT cache_key, row_number() OVER w - 1 AS n, sum(size) OVER w - size AS b, (SELECT count(*) FROM e) - 4000 AS ne,
                   (SELECT sum(size) - sum(size) * 6 // 10 FROM e) AS be FROM e WINDOW w AS (ORDER BY at_, cache_key ROWS UNBOUNDED PRECEDING)
        )
        SELECT cache_key FROM s WHERE n < ne OR b < be
    """,
    "jobs_keep_newest": """
        SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus IN ('F', 'O')
        QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) > 100
    """,
    "status_counts": """
        SELECT count(*) AS sources, count(*) FILTER (quality IS NULL) AS graph_pending, count(*) FILTER (quality = 1) AS graph_ready, count(*) FILTER (quality = 0) AS graph_failed,
               count(*) FILTER (toxic IS NULL) AS rag_pending, count(*) FILTER (toxic = 0) AS rag_ready, count(*) FILTER (toxic = 1) AS rag_failed
        FROM documents LEFT JOIN labels USING (doc_id)
    """,
    "cache_keys": "SELECT conv_id, turn, sha256(concat_ws('|', 'rag', text, 's', 'c', '{}')) AS cache_key FROM conversations WHERE role = 'user'",
    "scan_diff": """
        WITH k AS (SELECT o_orderkey AS p, o_orderpriority AS h, CASE WHEN o_orderstatus = 'P' THEN 'deleted' ELSE 'active' END AS x FROM orders WHERE o_orderkey % 10 <> 0),
        f AS (SELECT o_orderkey AS p, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS h FROM orders WHERE o_orderkey % 7 <> 0)
        SELECT * FROM (
            SELECT coalesce(k.p, f.p) AS path_hash, CASE WHEN k.p IS NULL THEN 'new' WHEN f.p IS NULL AND x = 'active' THEN 'deleted' WHEN f.p IS NULL THEN 'gone'
                WHEN x = 'deleted' THEN 'restored' WHEN k.h <> f.h THEN 'changed' ELSE 'unchanged' END AS change
            FROM k FULL JOIN f ON k.p = f.p
        ) WHERE change <> 'gone'
    """,
    "cdc_classify": f"WITH {_BATCH} SELECT source_uri, outcome FROM told",
    "cdc_merged_state": f"""
        WITH {_BATCH}
        SELECT source_uri, CASE WHEN {_TAKEN} THEN revision ELSE r0 END AS revision, CASE WHEN {_TAKEN} AND NOT deleted THEN content_hash ELSE h0 END AS content_hash,
               CASE WHEN {_TAKEN} THEN CASE WHEN deleted THEN 'deleted' ELSE 'active' END ELSE x0 END AS exists_status
        FROM told WHERE {_TAKEN} OR x0 IS NOT NULL
    """,
    "cdc_latest_state": """
        SELECT user_id, event_id AS revision, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'active' END AS exists_status, count(*) OVER (PARTITION BY user_id) AS changes
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
    "cdc_arrival": """
        WITH h AS (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events)
        SELECT user_id, CASE WHEN high IS NULL THEN 'created' WHEN ts < high THEN 'stale' ELSE 'updated' END AS outcome, count(*) AS n FROM h GROUP BY ALL
    """,
    "delete_document_cascade": f"""
        WITH {SQL_EVIDENCE}
        SELECT concat_ws('|', source_node_id, relation, target_node_id) AS edge_id, round(max(evidence_weight), 6) AS weight, count(DISTINCT source_id) AS support_count
        FROM evidence WHERE source_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY source_node_id, relation, target_node_id
    """,
    "delete_node_isolated_sources": """
        SELECT l_orderkey AS source_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1 AND bool_or(l_suppkey = 5)
    """,
    "integrity_violations": """
        SELECT DISTINCT l_orderkey AS source_id, CASE WHEN l_orderkey % 11 = 0 THEN 'missing_source' ELSE 'hash_mismatch' END AS violation
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 11 = 0 OR l_orderkey % 5 = 0
    """,
    "managed_paths": """
        SELECT page_id, '_managed/web/' || substr(regexp_replace(lower(url), '[^a-z0-9_-]+', '-', 'g'), 1, 80) || '-' || substr(sha256(url), 1, 12) || '.md' AS path,
               'page-' || substr(sha256(url), 1, 10) || '.md' AS name FROM pages
    """,
    "file_map": """
        WITH n AS (SELECT 'f' || c_custkey AS original, 'f' || (c_custkey + 12) AS markdown FROM customer WHERE c_custkey % 5 = 0)
        SELECT 'f' || c_custkey AS original, 'f' || (c_custkey + 10) AS markdown FROM customer
        WHERE 'f' || c_custkey NOT IN (SELECT original FROM n) AND 'f' || (c_custkey + 10) NOT IN (SELECT markdown FROM n) UNION ALL SELECT original, markdown FROM n
    """,
    "stream_cdc_foreachbatch": """
        SELECT 'user://' || user_id AS source_uri, event_id::VARCHAR AS revision, 'active' AS exists_status
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
}
