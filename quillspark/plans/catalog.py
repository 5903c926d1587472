"""Imports every query module so the registry is complete."""

from . import q_insights, q_io, q_profiles, q_quality, q_rollups, q_text, q_tools  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
