"""Parameters that change results, in two presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_query_depth: int = 5
    default_confidence: float = 0.7
    similarity_threshold: float = 0.6
    top_k: int = 10
    chunking_mode: str = "fixed"
    small_tokens: int = 128
    medium_tokens: int = 512
    large_tokens: int = 1024
    overlap_tokens: int = 64
    rerank_top_n: int = 5
    section_chars: int = 12_000
    path_limit: int = 50
    merge_similarity: float = 0.86
    entity_weight: float = 0.8
    community_weight: float = 0.6
    entity_top_k: int = 5
    community_top_k: int = 3
    planning_mode: str = "off"
    max_rewrites: int = 4
    max_subqueries: int = 3
    max_variants: int = 6
    drift_threshold: float = 0.58
    candidate_pool: int = 40
    rrf_k: int = 60
    rescue_count: int = 2
    anchor_factor: float = 1.2
    max_entities: int = 10
    summary_trigger: int = 5
    cache_entries: int = 10_000
    cache_bytes: int = 256 << 20
    max_documents: int = 1000


DEFAULTS = Settings()
SHIPPED = replace(
    DEFAULTS,
    chunking_mode="semantic_hierarchical",
    small_tokens=512,
    medium_tokens=1024,
    large_tokens=2048,
    overlap_tokens=128,
    planning_mode="auto",
)


def settings_of(values: dict, base: Settings = DEFAULTS) -> Settings:
    """Lenient: unknown names are ignored and values of a wrong type fall back one by one."""
    good = {}
    for f in fields(Settings):
        given, usual = values.get(f.name), getattr(base, f.name)
        if given is None or isinstance(given, bool):
            continue
        if isinstance(usual, float) and isinstance(given, int | float):
            good[f.name] = float(given)
        elif type(given) is type(usual):
            good[f.name] = given
    return replace(base, **good)
