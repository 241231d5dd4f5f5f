"""Settings of a run: from the environment, else these."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Limits of chunking and of the workflow. The environment names them QUIRE_<NAME>."""

    token_limit: int = 1200
    placeholder_limit: int = 12
    nav_units: int = 24
    retries: int = 3
    fallback_seconds: float = 60.0

    @classmethod
    def from_environment(cls) -> Settings:
        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[str(f.type)](os.environ[name]) for f in fields(cls) if (name := f"QUIRE_{f.name.upper()}") in os.environ})
