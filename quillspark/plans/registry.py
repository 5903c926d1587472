"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus the SQL oracle.

Each registered query binds a generic operator to the driver's tables.  The
oracle SQL sits next to the query so the two are reviewed together.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
