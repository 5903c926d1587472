"""Registry of the training-data queries, kept apart from the library's own."""

from __future__ import annotations

from collections.abc import Callable

LLM_QUERIES: dict[str, Callable] = {}
LLM_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in LLM_QUERIES:
            raise ValueError(f"duplicate query {name}")
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql.strip()
        return fn
    return deco
