"""Every registered query and its SQL."""

from __future__ import annotations

from . import correlations, flows, joins, ordered, people, private, profiles, records, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
