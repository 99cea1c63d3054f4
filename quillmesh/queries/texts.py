"""Queries over texts: tokens, chunks, pages, logs, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import chunking, planning
from quillmesh.sources import convert
from quillmesh.sources.tables import sources, table

SIZES, OVERLAP, BASE = (64, 256, 512), 32, 256
STEPS = chunking.level_steps(SIZES, OVERLAP, BASE)
FIXED_SIZE, FIXED_OVERLAP = 64, 8


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.fixed_chunks(table(spark, sf_dir, "documents"), FIXED_SIZE, FIXED_OVERLAP)
    return found.select("doc_id", "chunk_index", "token_start", "token_end", "token_count", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).cast("int").alias("n"))
    return chunking.chunk_tree(counted, SIZES, STEPS, "doc_id")


def hier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("doc_id", "chunk_index", "granularity", "token_start", "token_end")


def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("doc_id", "granularity", "token_start", "parent_granularity", "parent_start")


def chunk_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their root: parents are a row's own columns, so two joins by id climb the tree."""
    from quillmesh.operators.retrieval import with_family

    tree = _tree(spark, sf_dir)
    ids = tree.select(
        chunking.chunk_id(F.col("doc_id"), F.col("granularity"), F.col("token_start")).alias("chunk_id"),
        F.when(F.col("parent_start").isNotNull(), chunking.chunk_id(F.col("doc_id"), F.col("parent_granularity"), F.col("parent_start"))).alias("parent_chunk_id"),
    )
    return with_family(ids).select("chunk_id", "family_id")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("source_id", "content_hash", F.sha2(F.lower("relative_path"), 256).alias("path_hash"))


def lexical_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a query against every page: the best weighted containment."""
    asked = [("the", 1.0), ("and with", 0.85), ("/page", 0.65)]
    url = F.col("url")
    scores = [T.lexical_score(F.lit(q), url) * w for q, w in asked]
    return table(spark, sf_dir, "pages").select("page_id", F.greatest(*scores).alias("floor"))


def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at the edges of a language's documents that recur on enough of them, as headers on pages do; a header
    names the language, and on two thirds of the pages a footer the source."""
    footer = F.when(F.col("doc_id") % 3 != 0, F.lit("\n  all rights with the source ")).otherwise("")
    paged = F.concat(F.lit("collection "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")), footer)
    pages = table(spark, sf_dir, "documents").select(F.col("lang").alias("file_id"), F.col("doc_id").alias("page"), paged.alias("text"))
    return convert.repeated_edge_lines(pages)


def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("at"), F.array(F.col("p_partkey").cast("string"), "p_name", "p_type").alias("cells"))
    return convert.markdown_tables(part)


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.html_markdown(table(spark, sf_dir, "pages"), "page_id", "html")


def by_two(blocks: list[str]) -> list[tuple[int, int]]:
    """A stand-in for a model: two blocks a range; of texts with an exclamation mark it knows nothing."""
    if any("!" in b for b in blocks):
        raise ValueError("no ranges")
    return [(i, min(i + 1, len(blocks))) for i in range(1, len(blocks) + 1, 2)]


def semantic_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whose lines are blocks, in chunks of 64, 160 and 400 tokens along ranges of blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return chunking.semantic_hierarchy(docs, by_two, (64, 160, 400), 40)


def log_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Authorization: Bearer "), F.col("event_type"), F.col("event_id").cast("string"), F.lit(" api_key="), F.col("user_id").cast("string"), F.lit("; "), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", T.redact_log(line).alias("line"))


def rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.rule_entities(table(spark, sf_dir, "part"), "p_partkey", "p_name").unionByName(
        planning.rule_entities(table(spark, sf_dir, "pages").select(F.col("page_id").alias("p_partkey"), "url"), "p_partkey", "url")
    )


def entity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mentions = part.select(
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("normalized"),
        ((F.col("p_partkey") % 7) / 7).alias("confidence"), F.col("p_brand").alias("alias"), F.col("p_partkey").alias("pos"),
    )
    return planning.dedupe_entities(mentions)


def pre_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossless parts of at most 2,000 signs of every document."""
    parts = chunking.explode_parts(table(spark, sf_dir, "documents"), lambda t: chunking.pre_split(t, 2000))
    return parts.select("doc_id", "part_index", F.length("part").alias("signs"), F.md5(F.col("part").cast("binary")).alias("part_md5"))


def rebuilt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts put together again: the documents they came from."""
    parts = chunking.explode_parts(table(spark, sf_dir, "documents"), lambda t: chunking.heading_sections(t, 3000))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_index", "part"))).alias("l"))
    return whole.select("doc_id", F.md5(F.array_join(F.transform("l", lambda x: x["part"]), "").cast("binary")).alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        token_count, fixed_chunks, hier_chunks, chunk_parents, chunk_families, content_hashes, lexical_floor, repeated_edge_lines,
        markdown_table, html_to_markdown, log_redaction, rule_entities, entity_dedupe, pre_split_parts, rebuilt_texts, semantic_hierarchy,
    )
}

_TOKEN = "[㐀-鿿]|[A-Za-z0-9_]+|[^\\s]"
_COUNTED = f"counted AS (SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}')) AS n FROM documents)"
_LEVELS = " UNION ALL ".join(f"SELECT {i} AS lv, '{n}' AS granularity, {SIZES[i]} AS size, {STEPS[i]} AS step" for i, n in enumerate(chunking.LEVELS))
_TREE = f"""{_COUNTED}, levels AS ({_LEVELS}), windows AS (
    SELECT doc_id, lv, granularity, i * step AS s, least(i * step + size, n) AS e
    FROM counted, levels, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= size THEN 1 ELSE ceil((n - size) / step)::BIGINT + 1 END)) AS t(i)
), unique_ AS (
    SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY lv) = 1
), tree AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lv DESC, s, e) - 1 AS chunk_index FROM unique_
), parents AS (
    SELECT c.doc_id, c.lv, c.s, p.granularity AS pg, p.s AS ps,
           row_number() OVER (PARTITION BY c.doc_id, c.lv, c.s ORDER BY p.lv, p.e - p.s, p.s) AS r
    FROM tree c JOIN tree p ON c.doc_id = p.doc_id AND p.lv > c.lv AND p.s <= (c.s + c.e - 1) / 2.0 AND (c.s + c.e - 1) / 2.0 < p.e
), full_ AS (
    SELECT t.*, pg, ps FROM tree t LEFT JOIN (SELECT * FROM parents WHERE r = 1) USING (doc_id, lv, s)
)"""

ORACLE = {
    "rebuilt_texts": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''",
    "token_count": f"WITH {_COUNTED} SELECT doc_id, n AS tokens FROM counted",
    "fixed_chunks": f"""
        WITH parts AS (
            SELECT doc_id, string_split(regexp_replace(text, '({_TOKEN})', chr(1) || '\\1', 'g'), chr(1))[2:] AS p FROM documents
        ), spans AS (
            SELECT doc_id, p, i, i * {FIXED_SIZE - FIXED_OVERLAP} AS s, least(i * {FIXED_SIZE - FIXED_OVERLAP} + {FIXED_SIZE}, len(p)) AS e
            FROM parts, unnest(range(CASE WHEN len(p) = 0 THEN 0 WHEN len(p) <= {FIXED_SIZE} THEN 1
                ELSE ceil((len(p) - {FIXED_SIZE}) / {FIXED_SIZE - FIXED_OVERLAP})::BIGINT + 1 END)) AS t(i)
        )
        SELECT doc_id, i AS chunk_index, s AS token_start, e AS token_end, e - s AS token_count,
               md5(regexp_replace(array_to_string(p[s + 1:e], ''), '\\s+$', '')) AS content_md5
        FROM spans
    """,
    "hier_chunks": f"WITH {_TREE} SELECT doc_id, chunk_index, granularity, s AS token_start, e AS token_end FROM tree",
    "chunk_parents": f"WITH {_TREE} SELECT doc_id, granularity, s AS token_start, pg AS parent_granularity, ps AS parent_start FROM full_",
    "chunk_families": f"""
        WITH {_TREE}, ids AS (
            SELECT concat_ws(':', doc_id, granularity, s) AS id, CASE WHEN ps IS NOT NULL THEN concat_ws(':', doc_id, pg, ps) END AS up FROM full_
        )
        SELECT a.id AS chunk_id, coalesce(c.id, b.id, a.id) AS family_id
        FROM ids a LEFT JOIN ids b ON a.up = b.id LEFT JOIN ids c ON b.up = c.id
    """,
    "content_hashes": "SELECT doc_id AS source_id, sha256(text) AS content_hash, sha256(lower(source || '/' || doc_id || '.md')) AS path_hash FROM documents",
    "lexical_floor": """
        WITH q(t, w) AS (VALUES ('the', 1.0), ('and with', 0.85), ('/page', 0.65)), k AS (
            SELECT regexp_replace(t, '^[[:space:],;:.!?()\\[\\]{}<>"'']+|[[:space:],;:.!?()\\[\\]{}<>"'']+$', '', 'g') AS t, w FROM q
        ), u AS (
            SELECT page_id, lower(regexp_replace(url, '^[[:space:],;:.!?()\\[\\]{}<>"'']+|[[:space:],;:.!?()\\[\\]{}<>"'']+$', '', 'g')) AS url FROM pages
        )
        SELECT page_id, max(w::DOUBLE * CASE WHEN url = t THEN 1.0 WHEN contains(url, t) THEN 0.75 ELSE 0.0 END) AS floor FROM u, k GROUP BY page_id
    """,
    "repeated_edge_lines": """
        WITH pages AS (
            SELECT lang, doc_id, 'collection ' || lang || chr(10) || coalesce(text, '')
                   || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || '  all rights with the source ' ELSE '' END AS text
            FROM documents
        ), lines AS (
            SELECT lang AS file_id, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages
        ), edge AS (
            SELECT DISTINCT file_id, doc_id, unnest(list_distinct(list_concat(l[:2], l[-2:]))) AS line FROM lines
        ), need AS (SELECT lang AS file_id, greatest(3, ceil(count(*) / 2.0)) AS least_ FROM documents GROUP BY 1)
        SELECT file_id, line, count(*) AS pages FROM edge JOIN need USING (file_id) GROUP BY file_id, line, least_ HAVING count(*) >= least_
    """,
    "markdown_table": """
        SELECT p_brand AS sheet, string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' |', chr(10) ORDER BY p_partkey) AS rows_text
        FROM part GROUP BY p_brand
    """,
    "log_redaction": """SELECT event_id, 'Authorization: Bearer *** api_key=***; ' || props AS line FROM events""",
    "entity_dedupe": """
        WITH m AS (
            SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS normalized, (p_partkey % 7) / 7 AS confidence, p_brand AS alias, p_partkey AS pos FROM part
        )
        SELECT lower(normalized) AS key, arg_max(normalized, confidence * 1e9 - pos) AS normalized, max(confidence) AS confidence,
               list_sort(list_distinct(list(alias))) AS aliases
        FROM m GROUP BY 1
    """,
}
