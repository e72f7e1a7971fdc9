"""Registered queries and their independent SQL, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

_SUPPORT = {"registry", "ctes", "base", "booksql"}


def load() -> dict:
    from panelspark.queries.registry import REGISTRY

    for m in pkgutil.iter_modules(__path__):
        if m.name not in _SUPPORT:
            importlib.import_module(f"{__name__}.{m.name}")
    return REGISTRY
