"""Distance to the nearest line segment, exact at any range, over a pyramid of lattices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.functions.geo import M_PER_DEG, cell_index, segment_distance_m
from plotgap.plans.traversal import crossed_cells

CELL_DEG = 0.1
#: Each level's cells are four times as wide as the one's below; the last level's span the globe.
LEVELS = 7


def _narrowing(row: Column) -> Column:
    """Least cosine, never under 0.01, of the latitudes of a row of finest cells."""
    far = F.greatest(F.abs(row * CELL_DEG), F.abs((row + 1) * CELL_DEG))
    return F.greatest(F.cos(F.radians(F.least(far, F.lit(90.0)))), F.lit(0.01))


def segment_cells(segments: DataFrame, line_set: str = "line_set") -> DataFrame:
    """(line_set, x0, y0, x1, y1, level, c, r): the cells of every level that each segment crosses."""
    ends = ["x0", "y0", "x1", "y1"]
    fine = crossed_cells(segments.select(line_set, *ends).distinct(), [line_set, *ends], *ends, CELL_DEG)
    every = fine.select(line_set, *ends, "col", "row", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    return every.select(line_set, *ends, "level", F.expr("shiftright(col, 2 * level)").alias("c"), F.expr("shiftright(row, 2 * level)").alias("r")).distinct()


def _around(cells: DataFrame) -> DataFrame:
    """Each row once for every cell of the 3 x 3 about its own."""
    for v in ("c", "r"):
        cells = cells.withColumn(v, F.explode(F.sequence(F.col(v) - 1, F.col(v) + 1)))
    return cells


def candidates(cells: DataFrame, segments: DataFrame, line_set: str) -> DataFrame:
    """(_c0, _r0, line_set, x0, y0, x1, y1): for each occupied finest cell the segments that can be nearest to a place in it.

    A cell finds, for each line set, the lowest level at which the 3 x 3 cells about it hold a segment. That bounds its
    distance, so the 3 x 3 of the level whose cells are at least as wide as the bound hold all segments within it; of these, the
    ones whose distance from the cell's centre is over the bound and half the cell's diagonal drop out.
    """
    indexed = segment_cells(segments, line_set)
    occupied = _around(indexed.select(line_set, "level", "c", "r").distinct()).distinct()
    asked = cells.select("_c0", "_r0", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    asked = asked.select("_c0", "_r0", "level", F.expr("shiftright(_c0, 2 * level)").alias("c"), F.expr("shiftright(_r0, 2 * level)").alias("r"))
    first = asked.join(occupied, ["level", "c", "r"]).groupBy("_c0", "_r0", line_set).agg(F.min("level").alias("_first"))
    reach = F.lit(CELL_DEG * 2 * math.sqrt(2) * 1.001) * F.pow(F.lit(4.0), F.col("_first"))  # degrees of latitude
    narrow = _narrowing(F.col("_r0"))
    up = F.ceil(F.log(F.lit(2 * math.sqrt(2) * 1.001) / narrow) / math.log(4.0) - 1e-12)
    level = F.least(F.lit(LEVELS - 1), F.col("_first") + F.greatest(F.lit(1), up)).cast("int")
    wide = first.select("_c0", "_r0", line_set, reach.alias("_reach"), level.alias("level"))
    wide = wide.withColumn("c", F.expr("shiftright(_c0, 2 * level)")).withColumn("r", F.expr("shiftright(_r0, 2 * level)"))
    near = wide.join(_around(indexed), [line_set, "level", "c", "r"]).select("_c0", "_r0", line_set, "_reach", "x0", "y0", "x1", "y1").distinct()
    lon, lat = (F.col("_c0") + 0.5) * CELL_DEG, (F.col("_r0") + 0.5) * CELL_DEG
    centre = segment_distance_m(lon, lat, "x0", "y0", "x1", "y1")
    shrink = narrow / F.greatest(F.cos(F.radians(F.least(F.abs(lat), F.lit(90.0)))), F.lit(0.01))  # a place may measure east-west shorter than the centre
    half = CELL_DEG * M_PER_DEG * 0.75
    return near.where(centre * shrink - half <= F.col("_reach") * M_PER_DEG).drop("_reach")


def nearest_line(points: DataFrame, segments: DataFrame, key: str, line_set: str = "line_set",
                 lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, line_set, d_m) of the nearest segment of each line set, at any distance.

    Points are collapsed to their occupied cells to find candidates, by equi-joins on (level, cell) alone; only then is each
    point measured against its cell's candidates. Points without a place have no row.
    """
    pts = (points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(key, lon, lat)
           .withColumn("_c0", cell_index(lon, CELL_DEG)).withColumn("_r0", cell_index(lat, CELL_DEG)))
    seen = candidates(pts.select("_c0", "_r0").distinct(), segments, line_set)
    return (pts.join(seen, ["_c0", "_r0"])
            .groupBy(key, line_set)
            .agg(F.min(segment_distance_m(lon, lat, "x0", "y0", "x1", "y1")).alias("d_m")))
