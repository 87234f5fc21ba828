"""The catalogue: every named query and its SQL."""

from __future__ import annotations

from . import layer_queries, raster_queries, scalar_queries, shape_queries, spatial_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
