"""Query planning: variants, entities, drift.  Driver-side, as a plan has a handful of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import DEFAULTS, Settings
from quillmesh.functions.text import QUOTED, SPLIT, STOP_WORDS, comparison_key, plan_key, squeeze, strip_edges, text_of

#: Weights of rewrites by kind.
WEIGHTS = {"original": 1.0, "synonym": 0.85, "paraphrase": 0.80, "narrower": 0.75, "related": 0.65, "broader": 0.55, "subquery": 0.80}
MOST_SIGNS = 500


@dataclass(frozen=True)
class Variant:
    text: str
    kind: str
    weight: float


@dataclass(frozen=True)
class Entity:
    text: str
    normalized: str
    aliases: tuple[str, ...] = ()
    confidence: float = 1.0


@dataclass(frozen=True)
class QueryPlan:
    variants: tuple[Variant, ...]
    entities: tuple[Entity, ...] = ()
    degraded: bool = False
    notes: tuple[str, ...] = field(default=())


Planner = Callable[[str], dict]


def plan_query(query: str, planner: Planner | None = None, settings: Settings = DEFAULTS) -> QueryPlan:
    """The original alone, or with what the planner adds; a planner's failure degrades to the original."""
    original = Variant(text_of(query), "original", WEIGHTS["original"])
    if not original.text:
        raise ValueError("the query is empty")
    if planner is None or settings.planning_mode in ("off", "rule"):
        return QueryPlan((original,))
    try:
        return _built(original, planner(original.text), settings)
    except Exception as why:  # a model's failure is not the query's
        return QueryPlan((original,), degraded=True, notes=(str(why),))


def _built(original: Variant, said: dict, settings: Settings) -> QueryPlan:
    rewrites = [Variant(text_of(x["text"]), x["kind"], WEIGHTS[x["kind"]]) for x in said.get("rewrites", [])]
    parts = [Variant(text_of(x), "subquery", WEIGHTS["subquery"]) for x in said.get("subqueries", [])]
    out, seen = [original], {plan_key(original.text)}
    for most, group in ((settings.max_rewrites, rewrites), (settings.max_subqueries, parts)):
        taken = 0
        for v in group:
            key = plan_key(v.text)
            if v.text and len(v.text) <= MOST_SIGNS and key not in seen and taken < most:
                seen.add(key)
                out.append(v)
                taken += 1
    entities = [
        Entity(text_of(e["text"]), text_of(e.get("normalized") or e["text"]), tuple(text_of(a) for a in e.get("aliases", [])), float(e.get("confidence", 1.0)))
        for e in said.get("entities", [])
    ]
    return QueryPlan(tuple(out[: settings.max_variants + 1]), tuple(merge_entities(entities)[: settings.max_entities]))


def merge_entities(entities: list[Entity]) -> list[Entity]:
    """One entity a normalized form, in order of first mention; the surest spelling stays, aliases are united."""
    found: dict[str, Entity] = {}
    for e in entities:
        key = plan_key(e.normalized)
        old = found.get(key)
        if old is None:
            found[key] = e
            continue
        best = e if e.confidence > old.confidence else old
        aliases = tuple(dict.fromkeys([*old.aliases, *e.aliases]))
        found[key] = Entity(best.text, best.normalized, aliases, best.confidence)
    return [*found.values()]


def entities_of(plan: QueryPlan) -> list[Entity]:
    """The plan's entities, or else its variants as entities of their weight."""
    return [*plan.entities] or [Entity(v.text, v.text, (), v.weight) for v in plan.variants]


def entity_frame(spark: SparkSession, entities: list[Entity]) -> DataFrame:
    rows = [(i, e.text, e.normalized, [*e.aliases], e.confidence) for i, e in enumerate(entities)]
    return spark.createDataFrame(rows, "entity_idx int, text string, normalized string, aliases array<string>, confidence double")


def rule_terms(text: Column) -> Column:
    """Quoted spans, then what connectives and marks leave over; stop words and lone signs dropped."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))
    parts = F.concat(quoted, F.split(text, SPLIT))
    bare = F.transform(parts, lambda p: squeeze(strip_edges(p)))
    lone = lambda p: (F.length(p) == 1) & (F.octet_length(p) > 1)
    return F.filter(bare, lambda p: (p != "") & ~F.lower(p).isin(*STOP_WORDS) & ~lone(p))


def rule_entities(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, position, entity``: the rule's terms of any text column, first spelling of each."""
    spread = rows.select(key, F.posexplode(rule_terms(F.col(text))).alias("position", "entity"))
    folded = spread.withColumn("_k", comparison_key(F.col("entity")))
    return folded.groupBy(key, "_k").agg(F.min(F.struct("position", "entity")).alias("m")).select(key, F.col("m.position").cast("long").alias("position"), F.col("m.entity").alias("entity"))


def dedupe_entities(mentions: DataFrame) -> DataFrame:
    """``key, normalized, confidence, aliases`` out of ``normalized, confidence, alias, pos``: the table form of merging."""
    order = F.struct(F.col("confidence"), (-F.col("pos")).alias("p"))
    return mentions.groupBy(comparison_key(F.col("normalized")).alias("key")).agg(
        F.max_by("normalized", order).alias("normalized"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("alias")).alias("aliases"),
    )


