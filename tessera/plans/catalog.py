"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules that hold QUERIES (name -> function of session and folder) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("assessments", "bagging", "checks", "columns", "conditional", "confident", "features", "forecast", "models", "neighbourhood", "rules", "samples", "scaler", "scores", "search", "selections", "series", "steps", "summaries", "tails")


def _gather(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"tessera.plans.{name}"), kind).items():
            if key in found:
                raise ValueError(f"{key} is registered twice")
            found[key] = value
    return found


def queries() -> dict[str, Callable]:
    return _gather("QUERIES")


def oracles() -> dict[str, str]:
    return _gather("ORACLES")
