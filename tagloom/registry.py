"""The registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import services as services  # registers its queries
from .plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
