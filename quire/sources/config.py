"""Settings: environment over file over default. Credentials come from the environment alone."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "QUIRE_"


@dataclass(frozen=True)
class Settings:
    store: str = "quire-store"
    max_chars: int = 4000
    top_k: int = 5
    full_map: int = 300
    rounds: int = 6
    decider: str = "rule"
    base_url: str = "http://localhost:8000/v1"
    model: str = "default"
    seconds: float = 60.0
    api_key: str = field(default="", repr=False, metadata={"secret": True})
    authorization: str = field(default="", repr=False, metadata={"secret": True})


def load_settings(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """An empty variable counts as not set, and then the default holds, whatever the file says."""
    env = os.environ if environment is None else environment
    stated = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else {}
    found = {}
    for f in fields(Settings):
        value = env.get(PREFIX + f.name.upper())
        if value is None and not f.metadata.get("secret"):
            value = stated.get(f.name)
        if value not in (None, ""):
            found[f.name] = type(f.default)(value)
    return Settings(**found)
