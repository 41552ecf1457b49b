"""Every query by name, and its DuckDB SQL."""

from __future__ import annotations

from . import codecs, coding, elements, settings, spatial, temporal, verified  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
