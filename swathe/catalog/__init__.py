"""Every registered query, one module per family of operators."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def all_queries():
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLE
