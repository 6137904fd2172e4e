"""Named queries over the given tables, grouped as in the operator inventory."""

from __future__ import annotations

import importlib

_MODULES = [
    "stores", "scalars", "checks", "features", "modelling", "learning", "explore", "service", "streams",
]


def registry():
    from gridgale.plans.base import REGISTRY

    for module in _MODULES:
        importlib.import_module(f"gridgale.plans.{module}")
    return REGISTRY
