"""The dealt queries opN_<name> and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, dedup, languages, negatives, neighbours, packing, quality, rendering, secrets, sharding, syncmers
from .common import durable, table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


def op4_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rendering.render_pages(table(spark, sf_dir, "pages"))
    return done.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = durable(secrets.found_spans(table(spark, sf_dir, "documents")))
    kinds = F.array(*[F.lit(k) for k in secrets.KINDS])

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return secrets.scan_secrets(found).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, field).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP_FROM).cast("int").alias("predicted"),
    )


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack_documents(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "window",
        "step_group",
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT -1L conv_id, explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) t"
    ).select("conv_id", "t.turn", "t.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    log = chat.events_of_turns(turns.unionByName(probe))
    back = chat.read_back(chat.format_conversations(log))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = languages.held_out(F.col("doc_id").cast("long"))
    model = languages.train(docs.filter(~held_out))
    return languages.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_syncmer_fingerprints": op3_syncmer_fingerprints,
    "op4_html_rendering": op4_html_rendering,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_secret_scan": op6_secret_scan,
    "op7_byte_shards": op7_byte_shards,
    "op8_line_quality": op8_line_quality,
    "op9_hierarchical_packing": op9_hierarchical_packing,
    "op10_chat_format": op10_chat_format,
    "op11_language_id": op11_language_id,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    # op7: DuckDB has no crc32; tested against a brute-force version
    "op10_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), marked AS (
            SELECT *, regexp_replace(role, '(<<?|\[)(\\*)(/?(?:s>|INST\]|SYS>>))', '\1\\\2\3', 'g') AS role_,
                   regexp_replace(text, '(<<?|\[)(\\*)(/?(?:s>|INST\]|SYS>>))', '\1\\\2\3', 'g') AS text_
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               3 + sum(6 + length(role_) + 7 + length(text_) + 4)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op12_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
        ), seen AS (
            SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                   min(doc_id) OVER (PARTITION BY t) AS first_id
            FROM texts
        ), marks AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
        ), failing AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (len(words) < 200)::INT
                   + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                   + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT
                   + 16 * coalesce(doc_id > first_id, false)::INT AS mask
            FROM seen LEFT JOIN marks USING (doc_id)
        ), counts AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask
        ), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
                   [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a JOIN letters b ON a.bit <> b.bit
            JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
            JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit)
            JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
        ), steps AS (
            SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
            FROM orders, range(1, 6) AS s(step)
        ), walked AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM counts, steps GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM walked
    """,
    "op13_hard_negatives": r"""
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), anchors AS (
            SELECT * FROM usable WHERE vec_id % 100 = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
            FROM anchors a JOIN usable b ON a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), found AS (
            SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
            FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
             AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
    """,
}
