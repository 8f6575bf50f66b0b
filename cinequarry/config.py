"""Settings as nested dictionaries: defaults, a JSON file over them, ``a.b.c=value`` over both."""

from __future__ import annotations

import copy
import json
from pathlib import Path


def merge(base: dict, over: dict) -> dict:
    """``base`` with what ``over`` has; dictionaries are merged, anything else replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        both = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = merge(out[key], value) if both else copy.deepcopy(value)
    return out


def override(config: dict, item: str) -> dict:
    """``config`` with one ``a.b.c=value``: JSON where it can be read as such, else the text
    itself. Missing levels are made; a level that holds a plain value is an error."""
    path, found, text = item.partition("=")
    if not found or not all(path.split(".")):
        raise ValueError(f"{item!r} isn't of the form a.b.c=value")
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    for key in reversed(path.split(".")):
        value = {key: value}
    at, keys = config, path.split(".")[:-1]
    for key in keys:
        at = at.get(key, {})
        if not isinstance(at, dict):
            raise ValueError(f"{key!r} of {item!r} holds a plain value")
    return merge(config, value)


def load(path: str | None, defaults: dict, overrides: tuple[str, ...] = ()) -> dict:
    config = merge(defaults, json.loads(Path(path).read_text()) if path else {})
    for item in overrides:
        config = override(config, item)
    return config
