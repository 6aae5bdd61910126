"""Layered configuration: command line, environment, study file, global file."""

from __future__ import annotations

import json
import os
import tomllib
from typing import Any

from litlens.sources.recorded import provider_name


def load(path: str | None) -> dict[str, Any]:
    """A TOML or JSON file, empty where there is none."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        return json.load(f) if path.endswith(".json") else tomllib.load(f)


def resolve(name: str, argument: Any = None, environment: str | None = None, *files: dict[str, Any], default: Any = None) -> Any:
    """The first value given: argument, environment variable, then each file in turn. Only None counts as not given,
    so a false or zero argument holds."""
    for value in (argument, os.environ.get(environment) if environment else None, *[f.get(name) for f in files]):
        if value is not None:
            return value
    return default


def parse_bool(value: Any) -> bool:
    """True for true, 1, yes and on in any case; every other text is false, as published."""
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")


def databases(value: str | list[str] | None, default: tuple[str, ...] = ("pubmed",)) -> list[str]:
    """Canonical provider names of a list or a text divided by commas or semicolons, without repeats, in order."""
    parts = value.replace(";", ",").split(",") if isinstance(value, str) else (value or list(default))
    return list(dict.fromkeys(provider_name(p) for p in parts if p and p.strip()))


def enabled_providers(names: list[str], settings: dict[str, dict[str, Any]]) -> list[str]:
    """Canonical names of the providers to search; raises where the settings of one of them switch it off."""
    chosen = databases(names)
    if off := [p for p in chosen if settings.get(p, {}).get("enabled", True) is False]:
        raise ValueError(f"switched off: {', '.join(off)}")
    return chosen
