"""Configuration: profiles, routing policy, connectors, generations, the store's manifest."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .functions.text import CLASSIFICATIONS, DEFAULT_GENERATION
from .operators.reconcile import CANONICAL, INDEX_SCHEMA, LOCAL_ONLY, MANIFEST, METADATA_FORMAT, PIPELINE, SERVING


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Profile:
    id: str
    provider: str = "ollama"
    endpoint: str = ""
    model: str = ""
    locality: str = "local"


@dataclass
class Config:
    home: str
    profiles: list[Profile] = field(default_factory=lambda: [Profile("local")])
    default_profile: str | None = None
    routing: dict[str, str] = field(default_factory=dict)
    connectors: list[dict] = field(default_factory=list)
    generation: str = DEFAULT_GENERATION
    top_k: int = 25
    threshold: float = 0.3
    chunk_size: int = 3000
    chunk_overlap: int = 200
    #: Buckets of the store's tables; of an existing table its own number counts.
    buckets: int = 64

    def __post_init__(self) -> None:
        known = {p.id: p for p in self.profiles}
        self.default_profile = self.default_profile or self.profiles[0].id
        self.routing = {c: self.default_profile for c in CLASSIFICATIONS} | self.routing
        for c, p in self.routing.items():
            if p not in known:
                raise ConfigError(f"classification '{c}' is routed to unknown profile '{p}'")
            if c in LOCAL_ONLY and known[p].locality != "local":
                raise ConfigError(f"classification '{c}' must be routed to a local profile, not '{p}'")
        self.generation = self.generation.strip() if re.fullmatch(r"[A-Za-z0-9._-]+", self.generation.strip()) else DEFAULT_GENERATION

    @staticmethod
    def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
        """From YAML; LODESEAM_HOME, LODESEAM_CONFIG, LODESEAM_TOP_K and LODESEAM_THRESHOLD override."""
        env = os.environ if env is None else env
        path = env.get("LODESEAM_CONFIG", path)
        raw = yaml.safe_load(Path(expand(path)).read_text()) if path and Path(expand(path)).exists() else {}
        raw = raw or {}
        keep = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__}
        keep["home"] = expand(env.get("LODESEAM_HOME", raw.get("home", "~/.lodeseam")))
        if "profiles" in keep:
            keep["profiles"] = [Profile(**p) for p in keep["profiles"]]
        for name, kind in (("top_k", int), ("threshold", float)):
            if (v := env.get(f"LODESEAM_{name.upper()}")) is not None:
                keep[name] = kind(v)
        return Config(**keep)

    def select_connectors(self, wanted: list[str] | None = None, include_disabled: bool = False) -> list[dict]:
        """Enabled connectors, or those named, sorted by id; an unknown id is an error."""
        by_id = {c["id"]: c for c in self.connectors}
        if unknown := sorted(set(wanted or ()) - set(by_id)):
            raise ConfigError(f"unknown connector: {', '.join(unknown)}")
        chosen = [by_id[i] for i in (wanted or by_id)]
        return sorted((c for c in chosen if include_disabled or c.get("enabled", True)), key=lambda c: c["id"])


def expand(path: str) -> str:
    """``~`` and ``~/x`` only."""
    return str(Path.home()) + path[1:] if path == "~" or path.startswith("~/") else path


def key_value(text: str) -> tuple[str, str]:
    key, sep, value = text.partition("=")
    if not sep:
        raise ValueError(f"expected KEY=VALUE, got '{text}'")
    return key.strip(), value.strip()


def text_option(options: dict, key: str) -> str | None:
    value = options.get(key)
    return value.strip() or None if isinstance(value, str) else None


def list_option(options: dict, key: str) -> list[str]:
    value = options.get(key)
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


VERSIONS = {"index": INDEX_SCHEMA, "canonical": CANONICAL, "pipeline": PIPELINE, "serving": SERVING, "metadata": METADATA_FORMAT}
MANIFEST_VERSION = MANIFEST
