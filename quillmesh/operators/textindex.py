"""An index of terms by their grams: terms that contain, lie in or resemble a text, without comparing it with all.

The index is two tables, ``terms(node_id, keyword, term, is_name)`` and ``grams(gram, term)`` with the single
signs and neighbouring pairs of each term.  Kept as Parquet sorted by gram, a search reads the row groups of
the grams it asks for.  What is asked is one query's terms, so it is small; how often its grams occur is
counted first, and only its rarest ones are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import comparison_key, difflib_ratio, norm_keys_full, ratio_bound
from quillmesh.plans.components import durable

#: Scores of the ways in which a term can match a node.
EXACT, ALIAS, CONTAINED = 1.0, 0.9, 0.85


def term_table(nodes: DataFrame, key=comparison_key, keys=norm_keys_full) -> DataFrame:
    """``node_id, keyword, term, is_name`` of names and aliases; empty terms match nothing and are left out."""
    named = nodes.select("node_id", "keyword", key(F.col("keyword")).alias("name"), keys(F.col("aliases")).alias("others"))
    name = F.array(F.struct(F.col("name").alias("term"), F.lit(True).alias("is_name")))
    others = F.coalesce(F.transform("others", lambda t: F.struct(t.alias("term"), F.lit(False).alias("is_name"))), F.array().cast("array<struct<term:string,is_name:boolean>>"))
    return named.select("node_id", "keyword", F.explode(F.concat(name, others)).alias("t")).select("node_id", "keyword", "t.term", "t.is_name").filter("term != ''").distinct()


def gram_table(terms: DataFrame) -> DataFrame:
    """``gram, term``: single signs and pairs of neighbouring signs of each term."""
    sign = F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.col("term").substr(i, F.lit(1)))
    pair = F.when(F.length("term") > 1, F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.col("term").substr(i, F.lit(2))))
    every = F.array_distinct(F.concat(sign, F.coalesce(pair, F.array().cast("array<string>"))))
    return terms.select("term").distinct().select(F.explode(every).alias("gram"), "term")


def save(nodes: DataFrame, path: str, key=comparison_key, keys=norm_keys_full) -> None:
    """Write the index of nodes; its grams in order, so that a search reads little of them."""
    term_table(nodes, key, keys).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    terms = nodes.sparkSession.read.parquet(f"{path}/terms")
    gram_table(terms).repartitionByRange("gram", "term").sortWithinPartitions("gram", "term").write.parquet(f"{path}/grams")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/grams")


def _pairs(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(len(text) - 1)]


def resembling_grams(text: str, need: float, held: dict[str, int]) -> list[str] | None:
    """Grams of which every term that resembles the text by ``need`` has one; None where there are no such grams.

    Beside a similar term the text loses so many signs at most, and each takes two pairs of neighbouring
    signs with it: of one place more than can be lost, one stays.
    """
    lost = int(len(text) * (2 - 2 * need) / (2 - need) + 1e-9)
    for places, least in ((_pairs(text), 2 * lost + 1), (list(text), lost + 1)):
        if len(places) >= least:
            return sorted(places, key=lambda g: (held.get(g, 0), g))[:least]
    return None


def match_indexed(entities: DataFrame, terms: DataFrame, grams: DataFrame, threshold: float, fuzzy: bool = True, key=comparison_key, keys=norm_keys_full) -> DataFrame:
    """``node_id, keyword, score``: best of each node over all entities, score times confidence.

    ``entities(entity_idx, text, normalized, aliases, confidence)`` belong to one query.  An entity and a
    node are judged by the best way in which any of their terms match; only where none does, by
    the most similar spelling.
    """
    spark = terms.sparkSession
    said = entities.select("entity_idx", "confidence", key(F.col("normalized")).alias("primary"), keys(F.concat(F.array("text"), F.col("aliases"))).alias("alternates")).collect()
    asked: dict[tuple, None] = {}
    for e in said:
        for text in dict.fromkeys([e["primary"], *(e["alternates"] or [])]):
            if text:
                asked[e["entity_idx"], float(e["confidence"]), text, text == e["primary"], text in (e["alternates"] or [])] = None
    texts = sorted({a[2] for a in asked})
    wanted = sorted({g for t in texts for g in (*t, *_pairs(t))})
    held = {r["gram"]: r["n"] for r in grams.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count("*").alias("n")).collect()} if wanted else {}
    probes, inside, every = set(), set(), set()
    for _, confidence, text, _, _ in asked:
        inside |= {(text, text[i:j]) for i in range(len(text)) for j in range(i + 2, len(text) + 1)} | {(text, text)}
        if len(text) > 1:
            probes.add((text, min(_pairs(text), key=lambda g: (held.get(g, 0), g))))
        if fuzzy and confidence > 0:
            some = resembling_grams(text, max(0.0, min(1.0, (threshold - 1e-9) / confidence)), held)
            if some is None:
                every.add(text)
            else:
                probes |= {(text, g) for g in some}
    frame = lambda rows, names: F.broadcast(spark.createDataFrame(sorted(rows), names))  # noqa: E731  grows with the query alone
    looked_up = sorted({g for _, g in probes})
    met = grams.filter(F.col("gram").isin(looked_up)).join(frame(probes, "text string, gram string"), "gram").select("text", "term")
    met = met.unionByName(terms.select("term").join(frame(inside, "text string, term string"), "term").select("text", "term"))
    if every:
        met = met.unionByName(terms.select("term").distinct().select(F.explode(F.array(*map(F.lit, sorted(every)))).alias("text"), "term"))
    met = met.distinct()
    contained = (F.least(F.length("text"), F.length("term")) >= 2) & (F.col("text").contains(F.col("term")) | F.col("term").contains(F.col("text")))
    asking = frame(asked, "entity_idx long, confidence double, text string, is_primary boolean, is_alternate boolean")
    judged = met.withColumns({"equal": F.col("text") == F.col("term"), "contained": contained}).join(asking, "text")
    near = F.lit(False)
    if fuzzy:
        near = ~F.col("equal") & ~F.col("contained") & (ratio_bound(F.col("text"), F.col("term")) * F.col("confidence") >= threshold - 1e-9)
    kept = durable(judged.filter(F.col("equal") | F.col("contained") | near))
    if fuzzy:
        spelled = kept.filter("NOT equal AND NOT contained").select("text", "term").distinct().withColumn("alike", difflib_ratio("text", "term"))
        kept = kept.join(spelled, ["text", "term"], "left")
    else:
        kept = kept.withColumn("alike", F.lit(None).cast("double"))
    rows = terms.join(kept, "term")
    both = F.col("equal") & F.col("is_primary") & F.col("is_name")
    # an equal term tells an alias unless it is a name asked for as one
    alias = F.col("equal") & ((F.col("is_primary") & ~F.col("is_name")) | F.col("is_alternate"))
    lexical = F.when(both, EXACT).when(alias, ALIAS).when(F.col("contained"), CONTAINED)
    best = rows.groupBy("node_id", "keyword", "entity_idx", "confidence").agg(F.max(lexical).alias("lexical"), F.max("alike").alias("alike"))
    scored = best.select("node_id", "keyword", (F.coalesce("lexical", "alike") * F.col("confidence")).alias("score"))
    return scored.groupBy("node_id", "keyword").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
