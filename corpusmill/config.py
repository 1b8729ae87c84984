"""Configuration trees: references between files, deep merges, flat keys."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

REFERENCES = ("model_config", "data_config")


def load_config(path: str | Path, roots: tuple[str | Path, ...] = (".",)) -> dict[str, Any]:
    """A JSON (or, if a parser is installed, YAML) file; REFERENCES in it name files that are loaded in place.

    A name is looked up beside the file first, then in roots.
    """
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        config = json.loads(text)
    else:
        import yaml  # optional

        config = yaml.safe_load(text) or {}
    for key in REFERENCES:
        name = config.get(key)
        if isinstance(name, str):
            found = next((p for p in (Path(r) / name for r in (path.parent, *roots)) if p.exists()), None)
            if found is None:
                raise FileNotFoundError(name)
            config[key.removesuffix("_config")] = load_config(found, roots)
    return config


def merge_configs(base: dict, over: dict) -> dict:
    """over's values win; dicts on both sides are merged."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge_configs(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def flatten_config(config: dict, prefix: str = "") -> dict[str, Any]:
    """Keys joined by dots."""
    out = {}
    for key, value in config.items():
        out.update(flatten_config(value, f"{prefix}{key}.") if isinstance(value, dict) else {f"{prefix}{key}": value})
    return out


def missing_keys(config: dict, required: list[str]) -> list[str]:
    flat = flatten_config(config)
    return [k for k in required if k not in flat and not any(f.startswith(k + ".") for f in flat)]
