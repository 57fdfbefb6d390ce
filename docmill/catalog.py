"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

import importlib
import pkgutil

from docmill import queries
from docmill.registry import ORACLE_SQL, QUERIES

for _m in pkgutil.iter_modules(queries.__path__):
    importlib.import_module(f"docmill.queries.{_m.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
