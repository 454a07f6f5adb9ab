"""Settings of a run, as a typed object read from JSON; names it lacks keep their defaults, unknown ones are an error."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Chunking:
    size: int = 512
    overlap: int = 64


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    supersession_rules_path: str | None = None


@dataclass(frozen=True)
class Generation:
    model: str = "extractive"
    temperature: float = 0.0
    max_tokens: int = 512


@dataclass(frozen=True)
class Storage:
    incoming: str = "data/incoming"
    lake: str = "data/lake"
    hash_algorithm: str = "sha256"


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    storage: Storage = field(default_factory=Storage)

    @classmethod
    def read(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        parts = {f.name: f.default_factory for f in fields(cls)}
        made = {}
        for name, values in told.items():
            if name not in parts:
                raise ValueError(f"unknown section {name}")
            if unknown := set(values) - {f.name for f in fields(parts[name])}:
                raise ValueError(f"unknown settings in {name}: {', '.join(sorted(unknown))}")
            made[name] = parts[name](**values)
        return cls(**made)
