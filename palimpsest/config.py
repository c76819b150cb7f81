"""Layered settings: defaults, then a TOML file, then PALIMPSEST_* variables (two underscores nest), then what the caller passes."""

from __future__ import annotations

import copy
import os
import tomllib
from pathlib import Path

from .errors import ConfigError

#: Every key and its default; None is unset.
DEFAULTS: dict = {
    "archive_dir": "~/archives",
    "scan": {"home_scan_max_depth": 8, "skip_directories": [], "skip_system_trash": True},
    "search": {"ignore_case": False, "fixed_strings": False, "word_regexp": False, "max_count": 100, "format": "human", "archive": None},
    "ingest": {"output": None, "inputs": []},
    "scope": {"service": None, "account": None},
    "stats": {"archive": None},
    "serve": {"bind": "127.0.0.1:8741"},
    "compress": {"level": 3},
    "zip": {"max_uncompressed_bytes": 8 << 30},
    "log": {"filter": "info"},
}
PREFIX = "PALIMPSEST_"


def config_path(env: dict[str, str]) -> Path:
    """The file that PALIMPSEST_CONFIG names, or palimpsest/config.toml in the user's configuration folder."""
    home = Path(env.get("HOME", "~")).expanduser()
    if named := env.get(PREFIX + "CONFIG"):
        return home / named[2:] if named.startswith("~/") else Path(named)
    return Path(env.get("XDG_CONFIG_HOME") or home / ".config") / "palimpsest" / "config.toml"


def _typed(value: str, default, name: str):
    if isinstance(default, bool):
        if value.lower() not in ("true", "false", "1", "0"):
            raise ConfigError(f"{name}: not true or false: {value!r}")
        return value.lower() in ("true", "1")
    if isinstance(default, int):
        try:
            return int(value)
        except ValueError:
            raise ConfigError(f"{name}: not a number: {value!r}") from None
    if isinstance(default, list):
        return [x for x in value.split(os.pathsep) if x]
    return value


def _overlay(base: dict, new: dict, where: str = "") -> None:
    for key, value in new.items():
        name = f"{where}{key}"
        if key not in base:
            raise ConfigError(f"unknown setting {name}")
        if isinstance(base[key], dict):
            if not isinstance(value, dict):
                raise ConfigError(f"{name} is a table")
            _overlay(base[key], value, f"{name}.")
        elif base[key] is not None and type(value) is not type(base[key]):
            raise ConfigError(f"{name}: expected {type(base[key]).__name__}, not {type(value).__name__}")
        else:
            base[key] = value


def load(passed: dict | None = None, env: dict[str, str] | None = None) -> dict:
    """All settings. A missing file is fine; an unknown key or a wrong type is an error. ``passed`` has the same nesting."""
    env = dict(os.environ) if env is None else env
    out, path = copy.deepcopy(DEFAULTS), config_path(env)
    if path.is_file():
        try:
            _overlay(out, tomllib.loads(path.read_text()))
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from None
    for name, value in sorted(env.items()):
        if name.startswith(PREFIX) and name not in (PREFIX + "CONFIG", PREFIX + "LOG"):
            at, known, keys = out, DEFAULTS, name.removeprefix(PREFIX).lower().split("__")
            for k in keys[:-1]:
                at, known = (at.get(k), known.get(k)) if isinstance(at, dict) and isinstance(known, dict) else (None, None)
            if isinstance(at, dict) and isinstance(known, dict) and keys[-1] in at and not isinstance(known[keys[-1]], dict):
                at[keys[-1]] = _typed(value, known[keys[-1]], name)
    _overlay(out, passed or {})
    if out["search"]["format"] not in ("human", "json", "toon"):
        raise ConfigError(f"search.format: not human, json or toon: {out['search']['format']!r}")
    if out["search"]["max_count"] < 0:
        raise ConfigError("search.max_count: negative")
    home = env.get("HOME", "")
    if out["archive_dir"].startswith("~/") and home:
        out["archive_dir"] = f"{home}/{out['archive_dir'][2:]}"
    return out
