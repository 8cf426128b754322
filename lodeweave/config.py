"""Settings: defaults here, then a JSON or TOML file, then the environment (``LODEWEAVE__CHUNKING__TARGET_TOKENS=256``)."""

from __future__ import annotations

import functools
import json
import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

PREFIX = "LODEWEAVE"


@dataclass(frozen=True)
class Paths:
    raw: str = "data/raw"
    interim: str = "data/interim"
    processed: str = "data/processed"
    gold: str = "eval/gold"
    runs: str = "eval/runs"
    graph: str = "data/processed/graph"
    vectors: str = "data/processed/vectors"

    def resolved(self, root: str) -> Paths:
        """Relative paths under ``root``; what names a file system stays as it is."""
        whole = lambda p: p if "://" in p or os.path.isabs(p) else f"{root.rstrip('/')}/{p}"
        return replace(self, **{f.name: whole(getattr(self, f.name)) for f in fields(self)})


@dataclass(frozen=True)
class Models:
    extraction_model: str = "extractive"
    judge_model: str = "extractive"
    synthesis_model: str = "extractive"
    extraction_temperature: float | None = 0.0
    judge_temperature: float | None = 0.0
    local_base_url: str | None = None
    provider: str | None = None
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Embeddings:
    model_name: str = "hash"
    dim: int = 64
    batch_size: int = 32


@dataclass(frozen=True)
class Extraction:
    min_node_confidence: float = 0.65
    min_edge_confidence: float = 0.5


@dataclass(frozen=True)
class Retrieval:
    length_damping_chars: int = 800


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 512
    overlap_tokens: int = 64


@dataclass(frozen=True)
class Calibration:
    min_quadratic_kappa: float = 0.6
    length_bias_alpha: float = 0.05


@dataclass(frozen=True)
class Eval:
    calibration: Calibration = Calibration()


@dataclass(frozen=True)
class Settings:
    paths: Paths = Paths()
    models: Models = Models()
    embeddings: Embeddings = Embeddings()
    extraction: Extraction = Extraction()
    retrieval: Retrieval = Retrieval()
    chunking: Chunking = Chunking()
    eval: Eval = Eval()


def read_file(path: str) -> dict[str, Any]:
    """A settings file as a dictionary; none is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        return tomllib.load(f) if path.endswith(".toml") else json.load(f)


def overlaid(base: Any, given: dict[str, Any]) -> Any:
    """``base`` with the given values; an unknown name raises."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    if unknown := set(given) - set(known):
        raise ValueError(f"no settings {sorted(unknown)} in {type(base).__name__}")
    return replace(base, **{k: overlaid(known[k], v) if is_dataclass(known[k]) else v for k, v in given.items()})


def _from_environment(base: Any, prefix: str) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for f in fields(base):
        now, name = getattr(base, f.name), f"{prefix}__{f.name.upper()}"
        if is_dataclass(now):
            inner = _from_environment(now, name)
            if inner:
                out[f.name] = inner
        elif name in os.environ:
            raw = os.environ[name]
            out[f.name] = raw if isinstance(now, str) or not raw else json.loads(raw) if raw[0] in "{[-0123456789" or raw in ("true", "false", "null") else raw
    return out


@functools.cache
def get_settings(path: str = "lodeweave.toml") -> Settings:
    """The settings, read once; ``get_settings.cache_clear()`` reads them again."""
    found = overlaid(Settings(), read_file(path))
    return overlaid(found, _from_environment(found, PREFIX))
