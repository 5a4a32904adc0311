"""Queries over the driver's tables, one module for each area of the library."""

from __future__ import annotations

from . import browsing, catalogue, live, upkeep

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (catalogue, browsing, upkeep, live):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
