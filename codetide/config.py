"""Settings: command line over environment over TOML file over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any, get_type_hints

from .functions.languages import DEFAULT_EXCLUDED
from .operators.branches import PROTECTED
from .operators.rules import Thresholds

PREFIX = "CODETIDE_"


@dataclass(frozen=True)
class BranchSettings:
    target: str = ""
    stale_days: int = 30
    abandoned_days: int = 90
    protected: tuple[str, ...] = PROTECTED


@dataclass(frozen=True)
class OutputSettings:
    formats: tuple[str, ...] = ("terminal",)
    folder: str = "codetide-report"
    top_n: int = 20
    sort: str = "lines"


@dataclass(frozen=True)
class Settings:
    exclude: tuple[str, ...] = DEFAULT_EXCLUDED
    max_commits: int = 0
    since: str = ""
    duplicate_lines: int = 6
    fail_on_violations: bool = False
    thresholds: Thresholds = field(default_factory=Thresholds)
    branches: BranchSettings = field(default_factory=BranchSettings)
    output: OutputSettings = field(default_factory=OutputSettings)


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``; tables merge, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_environment(environment: dict[str, str], prefix: str = PREFIX) -> dict:
    """``PREFIX_A__B=x`` as ``{"a": {"b": "x"}}``."""
    out: dict = {}
    for name, value in environment.items():
        if name.startswith(prefix):
            *tables, key = name[len(prefix) :].lower().split("__")
            at = out
            for t in tables:
                at = at.setdefault(t, {})
            at[key] = value
    return out


def _read(value: Any, kind: Any, name: str) -> Any:
    origin = getattr(kind, "__origin__", None)
    if origin is tuple:
        return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(value)
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"{name}: {value!r} is neither true nor false")
        return value.lower() in ("1", "true", "yes", "on")
    try:
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name}: {value!r} is no {kind.__name__}") from e


def build(base: Any, values: dict, at: str = "") -> Any:
    """A copy of a settings object with ``values``; names that it does not have raise."""
    kinds, changes = get_type_hints(type(base)), {}
    known = {f.name for f in fields(base)}
    for k, v in values.items():
        name = f"{at}{k}"
        if k not in known:
            raise ValueError(f"unknown setting {name}")
        now = getattr(base, k)
        changes[k] = build(now, v, f"{name}.") if is_dataclass(now) else _read(v, kinds[k], name)
    return replace(base, **changes)


def load(file: str | Path | None = None, environment: dict[str, str] | None = None, over: dict | None = None) -> Settings:
    values: dict = {}
    if file:
        with open(file, "rb") as f:
            values = tomllib.load(f)
    values = deep_merge(values, from_environment(dict(os.environ) if environment is None else environment))
    return build(Settings(), deep_merge(values, over or {}))
