"""Options of the engine: defaults, overrides, secrets and display."""

from __future__ import annotations

import re
from typing import Any

_SECRET = re.compile(r"PASS(?:WORD)?|TOKEN|KEY|SECRET", re.IGNORECASE)


def merge(*layers: dict) -> dict:
    """Dictionaries merged key by key, later ones over earlier ones, nested ones inside."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def coerce(raw: str) -> Any:
    """A typed value of a written one: boolean words and 1 and 0, whole numbers, numbers, else the text."""
    lower = raw.strip().lower()
    if lower in ("true", "yes", "1"):
        return True
    if lower in ("false", "no", "0"):
        return False
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            continue
    return raw


def nested_set(config: dict, dotted: str, value: Any) -> dict:
    """A copy of ``config`` with the value at a dotted path."""
    head, _, rest = dotted.partition(".")
    return merge(config, {head: nested_set({}, rest, value) if rest else value})


def is_secret(key: str) -> bool:
    """Whether a key's value must not be shown."""
    return bool(_SECRET.search(key))


def redacted(config: dict) -> dict:
    """``config`` for display, values of secret keys hidden."""
    return {k: redacted(v) if isinstance(v, dict) else "***" if is_secret(k) and v else v for k, v in config.items()}
