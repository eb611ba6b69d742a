"""Configuration values: substitution of environment names, and constants."""

from __future__ import annotations

import re
from typing import Any


def substitute(value: Any, env: dict[str, Any], passes: int = 5) -> Any:
    """``$NAME`` and ``${NAME}`` replaced throughout a configuration, names in names too, at most ``passes`` deep."""
    if isinstance(value, dict):
        return {k: substitute(v, env, passes) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env, passes) for v in value]
    if not isinstance(value, str):
        return value
    for _ in range(passes):
        new = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: str(env[m[1] or m[2]]) if (m[1] or m[2]) in env else m[0], value)
        if new == value:
            break
        value = new
    return value


def constant(text: str, env: dict[str, Any] | None = None) -> Any:
    """``NULL``, ``NaN``, ``'text'``, ``$NAME``, a double when there is a point, else an integer."""
    text = substitute(text, env or {})
    if not isinstance(text, str):
        return text
    s = text.strip()
    if s in ("NULL", "null"):
        return None
    if s in ("NaN", "nan"):
        return float("nan")
    if len(s) >= 2 and s[0] == s[-1] == "'":
        return s[1:-1]
    try:
        return float(s) if "." in s else int(s)
    except ValueError:
        return text
