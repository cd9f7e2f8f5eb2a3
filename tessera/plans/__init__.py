"""Queries of the raster operators over fixtures derived from the driver's tables."""

from . import q_blocks, q_grids, q_more, q_radar, q_routes, q_windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
