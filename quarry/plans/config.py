"""Settings with their defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    ensemble_top_k: int = 10
    fast_top_k: int = 5
    multi_query_variants: int = 3
    rerank_top_n: int = 5
    request_delay: float = 1.0
    user_agent: str = "quarry"
    scope_paths: tuple[str, ...] = ("/buying-a-flat/", "/selling-a-flat/", "/managing-my-home/")
    embedding_dim: int = 256

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Config:
        """Defaults, or what QUARRY_<NAME> says; lists are separated by commas."""
        kinds = {"int": int, "float": float, "str": str, "tuple[str, ...]": lambda v: tuple(x for x in v.split(",") if x)}
        return cls(**{f.name: kinds[f.type](env[name]) for f in fields(cls) if (name := f"QUARRY_{f.name.upper()}") in env})
