"""Imports every query module of the subpackage so that its registry is complete."""

from . import decontam, html_extract, jaccard, licenses, merkle, multiset_hash, nra, packing, quality, secret_scan, token_hist, token_orc, vptree  # noqa: F401
from .registry import LLM_ORACLE, LLM_QUERIES

__all__ = ["LLM_QUERIES", "LLM_ORACLE"]
