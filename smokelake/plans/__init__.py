"""Registered queries, one for each operator, with the SQL text that must give the same rows."""

from . import boxes, dataset, events, frames, live, matching, plugins, raster, streams, tiles, tracking  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
