"""All core queries and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from slatewise import queries
from slatewise.registry import ORACLE, QUERIES

for _m in pkgutil.iter_modules(queries.__path__):
    importlib.import_module(f"slatewise.queries.{_m.name}")

__all__ = ["ORACLE", "QUERIES"]
