"""Options: defaults < file < arguments, merged key by key; an unknown key is an error."""

from __future__ import annotations

import json


def merged(base: dict, over: dict) -> dict:
    """A new dict: nested dicts merge, other values of `over` win."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def options(defaults: dict, *layers: dict) -> dict:
    out = defaults
    for layer in layers:
        if unknown := sorted(_unknown(defaults, layer)):
            raise KeyError(f"unknown options: {unknown}")
        out = merged(out, layer)
    return out


def _unknown(known: dict, given: dict, at: str = "") -> list[str]:
    out = []
    for k, v in given.items():
        if k not in known:
            out.append(at + k)
        elif isinstance(v, dict) and isinstance(known[k], dict) and known[k]:
            out += _unknown(known[k], v, f"{at}{k}.")
    return out


def load(path: str) -> dict:
    """A JSON file, or YAML where a parser is installed."""
    with open(path) as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need a YAML parser") from e
        return yaml.safe_load(f) or {}
