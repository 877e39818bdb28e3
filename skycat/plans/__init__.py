"""The registered queries of the catalogue operators, and the SQL they are compared with."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in ("maps", "catalogues", "events", "hot", "stars", "loading"):
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
