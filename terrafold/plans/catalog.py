"""Imports every query module so that ``QUERIES`` is complete."""

from terrafold.plans import q_areas, q_blocks, q_clip, q_geometry, q_graph, q_imports, q_map, q_network, q_planar, q_raster, q_spatial, q_tags, q_windows  # noqa: F401
from terrafold.plans.registry import QUERIES

__all__ = ["QUERIES"]
