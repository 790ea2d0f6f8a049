"""Settings from the environment; a value that is no good is an error, not a default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from sightline.sources.corpus import root_of


@dataclass(frozen=True)
class Settings:
    warehouse: str
    blob_backend: str
    blob_root: str
    shuffle_partitions: int
    accept: int
    review: int
    write: float

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ) -> Settings:
        def number(name: str, default: float, lo: float, hi: float) -> float:
            try:
                value = float(env.get(name, default))
            except ValueError:
                raise ValueError(f"{name} is no number: {env[name]!r}") from None
            if not lo <= value <= hi:
                raise ValueError(f"{name} must lie between {lo} and {hi}")
            return value

        backend = env.get("SIGHTLINE_BLOB_BACKEND", "fs")
        return cls(
            env.get("SIGHTLINE_WAREHOUSE", "warehouse"), backend, root_of(backend, env.get("SIGHTLINE_BLOBS", "blobs")),
            int(number("SIGHTLINE_PARTITIONS", 200, 1, 1_000_000)), int(number("SIGHTLINE_ACCEPT", 92, 0, 100)), int(number("SIGHTLINE_REVIEW", 75, 0, 100)), number("SIGHTLINE_WRITE", 0.80, 0, 1),
        )
