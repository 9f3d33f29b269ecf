"""Registered queries with their SQL oracles, on inputs derived from the driver tables."""

from __future__ import annotations


def all_queries() -> None:
    """Imports every group, which registers its queries."""
    from checks import aggregating, analytics, cleaning, deriving, governing, moving, searching, tagging  # noqa: F401
