"""Credentials and settings, resolved where they are used, never in a plan."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


def read_env_file(path: str) -> dict[str, str]:
    """KEY=value lines; blank lines and # comments are skipped, quotes around a value removed."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                out[key.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out


@dataclass(frozen=True)
class Config:
    """Setting lookup: explicit values first, then the process environment."""

    values: Mapping[str, str] = field(default_factory=dict)

    def get(self, key: str) -> str | None:
        return self.values.get(key) or os.environ.get(key)

    def require(self, *keys: str) -> dict[str, str]:
        missing = [k for k in keys if not self.get(k)]
        if missing:
            raise KeyError(f"missing settings: {', '.join(missing)}")
        return {k: self.get(k) for k in keys}  # type: ignore[misc]
