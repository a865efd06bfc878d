"""Registered queries with their DuckDB equivalents."""

from importlib import import_module

MODULES = ("events", "text", "moments", "cues", "speakers", "media", "learning", "streams")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = import_module(f"reelspan.catalog.{_name}")
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
