"""Settings: the defaults of the engine, each of which an environment variable can override."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Limits and weights that queries share; TESSELLA_<NAME> in the environment overrides a field."""

    limit: int = 10
    pair_limit: int = 8
    max_per_type: int = 2
    min_weight: float = 0.0
    type_match_threshold: float = 0.85
    rrf_k: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    session_ttl_hours: int = 6
    session_capacity: int = 500
    history_turns: int = 12

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        given = {f.name: kinds[str(f.type)](env[f"TESSELLA_{f.name.upper()}"]) for f in fields(cls) if f"TESSELLA_{f.name.upper()}" in env}
        return cls(**given)


#: The settings of this process.
SETTINGS = Settings.from_env()
