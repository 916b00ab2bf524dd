"""Settings of the engine in one place; every operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Sizes, weights and lifetimes."""

    tender_chunk: int = 500
    tender_overlap: int = 80
    profile_chunk: int = 800
    profile_overlap: int = 100
    representatives: int = 5
    dimensions: int = 64
    first_pages: int = 15_000
    relevant_chars: int = 100_000
    relevant_tables: int = 15
    least_table_chars: int = 20
    weight_multi: float = 1.0
    weight_mean: float = 0.8
    weight_query: float = 0.9
    weight_vector: float = 0.7
    weight_keyword: float = 0.3
    most_boost: float = 0.2
    snippet_chars: int = 350
    boost_chars: int = 500
    ttl_days: int = 15
    cache_hours: int = 168
    sync_mb: int = 5


DEFAULTS = Config()
