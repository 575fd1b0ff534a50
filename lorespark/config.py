"""Settings: defaults, then a YAML or JSON file, then variables ``LORESPARK_SECTION_KEY``; unknown keys are ignored."""

from __future__ import annotations

import json
import os
from copy import deepcopy

DEFAULTS = {
    "retrieval": {"top_k": 5, "dense_weight": 0.7, "sparse_weight": 0.3, "least_score": 0.1, "sub_queries": 4},
    "chunking": {"size": 1000, "overlap": 100, "parent_size": 1500, "child_size": 400, "child_overlap": 50},
    "graph": {"hops": 2, "expansion": 3, "least_shared": 2},
    "quality": {"semantic_threshold": 0.85, "min_cases": 5},
}


def _value(text: str) -> object:
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def load(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "LORESPARK") -> dict[str, dict[str, object]]:
    """The settings; a missing file is no error."""
    out = deepcopy(DEFAULTS)
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(text) or {}
        else:
            given = json.loads(text or "{}")
        for section, values in given.items():
            if section in out and isinstance(values, dict):
                out[section] |= {k: v for k, v in values.items() if k in out[section]}
    env = os.environ if environ is None else environ
    for section, values in out.items():
        for key in values:
            name = f"{prefix}_{section}_{key}".upper()
            if name in env:
                values[key] = _value(env[name])
    return out
