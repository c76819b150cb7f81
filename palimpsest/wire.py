"""Media types of requests and replies, and the TOON text form of JSON values."""

from __future__ import annotations

import json
from typing import Any

#: The media types of the two forms.
JSON, TOON = "application/json", "application/toon"


def accepted(header: str | None) -> str:
    """The form of a reply, from an Accept header: the one with the larger q; JSON on a tie, and if neither is named."""
    best = {JSON: -1.0, TOON: -1.0}
    for part in (header or "").split(","):
        kind, *params = (x.strip().lower() for x in part.split(";"))
        q = next((float(p[2:]) for p in params if p.startswith("q=") and p[2:].replace(".", "", 1).isdigit()), 1.0)
        for own in (JSON, TOON):
            if kind == own:
                best[own] = max(best[own], q)
    return TOON if best[TOON] > max(best[JSON], 0) else JSON


def _cell(x: Any) -> str:
    if not isinstance(x, str):
        return json.dumps(x)
    plain = x and x == x.strip() and not any(c in x for c in ',:"\\\n\r\t[]{}') and x not in ("true", "false", "null") and not x.startswith("-") and not x.replace(".", "", 1).isdigit()
    return x if plain else json.dumps(x, ensure_ascii=False)


def _lines(key: str, x: Any, indent: int) -> list[str]:
    pad = "  " * indent
    if isinstance(x, dict):
        return [f"{pad}{key}:", *(line for k, v in x.items() for line in _lines(_cell(k), v, indent + 1))] if key else [line for k, v in x.items() for line in _lines(_cell(k), v, indent)]
    if not isinstance(x, list):
        return [f"{pad}{key}: {_cell(x)}" if key else pad + _cell(x)]
    scalar = lambda v: not isinstance(v, (dict, list))
    if all(map(scalar, x)):
        return [f"{pad}{key}[{len(x)}]:" + (" " + ",".join(map(_cell, x)) if x else "")]
    keys = list(x[0]) if isinstance(x[0], dict) else []
    if keys and all(isinstance(v, dict) and list(v) == keys and all(map(scalar, v.values())) for v in x):  # a table
        return [f"{pad}{key}[{len(x)}]{{{','.join(map(_cell, keys))}}}:", *(f"{pad}  " + ",".join(_cell(v[k]) for k in keys) for v in x)]
    out = [f"{pad}{key}[{len(x)}]:"]
    for v in x:
        own = _lines("", v, indent + 2)
        out.append(f"{pad}  - " + own[0].lstrip() if own else f"{pad}  -")
        out += own[1:]
    return out


def to_toon(x: Any) -> str:
    """A JSON value as TOON: indented keys, counts behind arrays, rows with one set of scalar keys as a table."""
    return "\n".join(_lines("", x, 0))
