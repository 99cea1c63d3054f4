"""Graph drafts: what an extractor says of a section, validated, merged per source, made into mentions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from quillmesh.functions.text import key_of, text_of
from quillmesh.operators.chunking import heading_sections

MOST_ENTITIES, MOST_RELATIONS = 1000, 2000
_ENTITY = {"local_id", "keyword", "summary", "aliases", "tags", "evidence_weight", "evidence"}
_RELATION = {"source", "relation", "target", "evidence_weight", "evidence"}


@dataclass(frozen=True)
class DraftEntity:
    local_id: str
    keyword: str
    summary: str = ""
    aliases: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    weight: float = 1.0
    evidence: str = ""

    def terms(self) -> set[str]:
        return {k for k in map(key_of, (self.keyword, *self.aliases)) if k}


@dataclass(frozen=True)
class DraftRelation:
    source: str
    relation: str
    target: str
    weight: float = 1.0
    evidence: str = ""


@dataclass(frozen=True)
class Draft:
    entities: tuple[DraftEntity, ...] = field(default=())
    relations: tuple[DraftRelation, ...] = field(default=())


def _weight(x: object) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float) or not 0 <= x <= 1:
        raise ValueError(f"weight {x!r} must lie in 0..1")
    return float(x)


def parse_draft(said: dict) -> Draft:
    """Strict: unknown fields, unknown ends, self-loops and repeated ids raise."""
    if set(said) - {"schema_version", "entities", "relations"}:
        raise ValueError("unknown fields in the draft")
    entities, relations = [], []
    for e in said.get("entities", []):
        if set(e) - _ENTITY or not text_of(e.get("keyword", "")):
            raise ValueError("an entity has unknown fields or no keyword")
        names = lambda k: tuple(text_of(x) for x in e.get(k, []))  # noqa: B023, E731
        entities.append(DraftEntity(str(e["local_id"]), text_of(e["keyword"]), e.get("summary", ""), names("aliases"), names("tags"), _weight(e.get("evidence_weight", 1.0)), e.get("evidence", "")))
    known = {e.local_id for e in entities}
    if len(known) != len(entities) or len(entities) > MOST_ENTITIES:
        raise ValueError("local ids repeat, or there are too many entities")
    for r in said.get("relations", []):
        if set(r) - _RELATION or not {r["source"], r["target"]} <= known or r["source"] == r["target"] or not text_of(r["relation"]):
            raise ValueError("a relation has unknown fields, unknown ends, or is a loop")
        relations.append(DraftRelation(str(r["source"]), text_of(r["relation"]), str(r["target"]), _weight(r.get("evidence_weight", 1.0)), r.get("evidence", "")))
    if len(relations) > MOST_RELATIONS:
        raise ValueError("there are too many relations")
    return Draft(tuple(entities), tuple(relations))


def split_draft(said: dict) -> list[dict]:
    """What an extractor says, in drafts within the limits; ``merge_drafts`` joins their entities again.

    Entities come in runs, then relations in runs with both of their ends.  Drafts within the limits, and ones that are wrong, stay as they are.
    """
    entities, relations = said.get("entities", []), said.get("relations", [])
    if len(entities) <= MOST_ENTITIES and len(relations) <= MOST_RELATIONS:
        return [said]
    by_id = {str(e["local_id"]): e for e in entities}
    if len(by_id) != len(entities) or any(r["source"] not in by_id or r["target"] not in by_id for r in relations):
        return [said]
    rest = {k: v for k, v in said.items() if k not in ("entities", "relations")}
    out = [{**rest, "entities": entities[i : i + MOST_ENTITIES], "relations": []} for i in range(0, len(entities), MOST_ENTITIES)]
    most = min(MOST_RELATIONS, MOST_ENTITIES // 2)  # with two ends each
    for i in range(0, len(relations), most):
        some = relations[i : i + most]
        ends = dict.fromkeys(x for r in some for x in (r["source"], r["target"]))
        out.append({**rest, "entities": [by_id[x] for x in ends], "relations": some})
    return out


def merge_drafts(drafts: list[Draft]) -> Draft:
    """One draft of a source: entities that share a term, over any chain, become one.

    The first keyword stays; the longest summary and evidence, the largest weight, all aliases
    and tags; relations by ends and name keep the largest weight, loops vanish.
    """
    groups: list[list[tuple[int, DraftEntity]]] = []
    of_term: dict[str, int] = {}
    for d, draft in enumerate(drafts):
        for e in draft.entities:
            met = sorted({of_term[t] for t in e.terms() if t in of_term})
            to = met[0] if met else len(groups)
            if not met:
                groups.append([])
            groups[to].append((d, e))
            for other in met[1:]:
                groups[to] += groups[other]
                groups[other] = []
                for t, g in of_term.items():
                    if g == other:
                        of_term[t] = to
            for t in e.terms():
                of_term[t] = to
    entities, ids = [], {}
    for members in groups:
        if not members:
            continue
        first = members[0][1]
        own = f"e{len(entities)}"
        others = dict.fromkeys(n for _, e in members for n in (e.keyword, *e.aliases) if key_of(n) != key_of(first.keyword))
        seen: dict[str, str] = {}
        for n in others:
            seen.setdefault(key_of(n), n)
        entities.append(
            replace(
                first, local_id=own, aliases=tuple(seen.values()), tags=tuple(dict.fromkeys(t for _, e in members for t in e.tags)),
                summary=max((e.summary for _, e in members), key=len), evidence=max((e.evidence for _, e in members), key=len), weight=max(e.weight for _, e in members),
            )
        )
        ids |= {(d, e.local_id): own for d, e in members}
    relations: dict[tuple, DraftRelation] = {}
    for d, draft in enumerate(drafts):
        for r in draft.relations:
            moved = replace(r, source=ids[d, r.source], target=ids[d, r.target])
            key = (moved.source, key_of(moved.relation), moved.target)
            old = relations.get(key)
            if moved.source != moved.target and (old is None or moved.weight > old.weight):
                relations[key] = replace(moved, relation=old.relation if old else moved.relation)
    return Draft(tuple(entities), tuple(relations.values()))


Extractor = Callable[[str], dict]
MENTIONS = (
    "source_id string, content_hash string, error string, local_id string, keyword string, summary string, aliases array<string>, tags array<string>, "
    "weight double, evidence string, relation string, target_id string"
)


def extract_mentions(sources: DataFrame, extractor: Extractor, section_chars: int = 12_000) -> DataFrame:
    """MENTIONS of ``source_id, content_hash, text``: a row an entity, a row a relation (``relation`` set).

    A source whose extraction fails gives a single row with the error; others aren't touched.
    """
    names = [x.split()[0] for x in MENTIONS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for source, content, text in zip(f["source_id"], f["content_hash"], f["text"], strict=True):
                try:
                    said = [part for x in heading_sections(text or "", section_chars) for part in split_draft(extractor(x))]
                    draft = merge_drafts([parse_draft(x) for x in said])
                except Exception as why:  # a document's failure is its own
                    out.append((source, content, f"{type(why).__name__}: {why}", *[None] * 9))
                    continue
                out += [(source, content, None, e.local_id, e.keyword, e.summary, [*e.aliases], [*e.tags], e.weight, e.evidence, None, None) for e in draft.entities]
                out += [(source, content, None, r.source, None, None, None, None, r.weight, r.evidence, r.relation, r.target) for r in draft.relations]
            yield pd.DataFrame(out, columns=names)

    return sources.select("source_id", "content_hash", "text").mapInPandas(run, MENTIONS)


def rule_extractor(text: str) -> dict:
    """The default: headings, and capitalised words that recur, related by their order under a heading."""
    import re

    words = re.findall(r"\b[A-ZÀ-Þ][\w-]{3,}\b", text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    names = [h.strip() for h in re.findall(r"(?m)^#{1,6}\s+(.+)$", text)] + [w for w, n in counts.items() if n >= 2]
    unique: dict[str, str] = {}
    for n in names:
        if key_of(n):
            unique.setdefault(key_of(n), n)
    chosen = [*unique.values()]
    entities = [{"local_id": str(i), "keyword": n, "evidence_weight": min(1.0, counts.get(n, 2) / 10)} for i, n in enumerate(chosen)]
    relations = [{"source": str(i), "relation": "near", "target": str(i + 1), "evidence_weight": 0.5} for i in range(len(chosen) - 1)]
    return {"schema_version": "1.0", "entities": entities, "relations": relations}
