"""Queries over the test tables, grouped like the operators they exercise."""

from __future__ import annotations

import importlib

MODULES = ("sources", "profiling", "cleaning", "features", "modelling")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
