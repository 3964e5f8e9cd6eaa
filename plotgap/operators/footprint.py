"""Polygon containment for literal footprints and for polygon tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.functions.geo import col, crosses_ray


def inside_rings(lon, lat, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd test against literal rings; holes are simply further rings."""
    crossings = F.lit(0)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                hit = crosses_ray(lon, lat, F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by))
                crossings = crossings + F.when(hit, 1).otherwise(0)
    return crossings % 2 == 1


def in_polygons(points: DataFrame, edges: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points inside the polygon of the same key; ``edges(keys, x0, y0, x1, y1)`` lists all rings.

    The edges of a key are packed into one array (a footprint has tens of vertices),
    so each point meets its polygon once and points are not multiplied by edges.
    """
    packed = edges.groupBy(*keys).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_edges"))
    crossings = F.size(F.filter("_edges", lambda s: crosses_ray(col(lon), col(lat), s["x0"], s["y0"], s["x1"], s["y1"])))
    return points.join(packed, keys).where(crossings % 2 == 1).drop("_edges")
