"""Configuration files and overrides by dotted names."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from typing import Any

import yaml


def load(path: str) -> dict[str, Any]:
    """A YAML file; one that is empty gives nothing."""
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def save(path: str, config: Mapping[str, Any]) -> None:
    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(dict(config), file, sort_keys=False, allow_unicode=True)


def overridden(config: Mapping[str, Any], values: Mapping[str, Any]) -> dict[str, Any]:
    """A copy with values set by names like ``a.b.c``; what is no mapping on the way is
    replaced by one."""
    made = deepcopy(dict(config))
    for name, value in values.items():
        *way, last = name.split(".")
        at = made
        for key in way:
            if not isinstance(at.get(key), dict):
                at[key] = {}
            at = at[key]
        at[last] = value
    return made
