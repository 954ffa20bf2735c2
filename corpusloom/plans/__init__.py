"""Registered queries by group."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("text_scalars", "mining", "takes", "errors", "series", "rewriting", "spoken", "stress", "records")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"corpusloom.plans.{name}")
