"""Role binding and the registry of checkable queries."""

from __future__ import annotations

import importlib

MODULES = ["sources", "integrity", "profiling", "derivation", "rollup", "exploration", "screening",
           "targets", "privacy", "assurance"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
