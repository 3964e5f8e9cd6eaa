"""Geodesy and grid arithmetic as Column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotgap.constants import EARTH_RADIUS_M, LEVELS, M_PER_DEG


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # not least(): that would turn a missing position into half the globe
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, degrees clockwise from north in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def project_point(lat, lon, bearing, dist_m) -> Column:
    """struct(lat, lon) reached by travelling ``dist_m`` along ``bearing``."""
    lat, lon, bearing, dist_m = map(col, (lat, lon, bearing, dist_m))
    d, b, p1 = dist_m / EARTH_RADIUS_M, F.radians(bearing), F.radians(lat)
    sin_p2 = F.sin(p1) * F.cos(d) + F.cos(p1) * F.sin(d) * F.cos(b)
    p2 = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_p2)))
    dl = F.atan2(F.sin(b) * F.sin(d) * F.cos(p1), F.cos(d) - F.sin(p1) * F.sin(p2))
    lon2 = F.pmod(F.degrees(F.radians(lon) + dl) + 540.0, F.lit(360.0)) - 180.0
    return F.struct(F.degrees(p2).alias("lat"), lon2.alias("lon"))


def equirect_m(lat1, lon1, lat2, lon2) -> Column:
    """Locally flat distance in metres, scaled at the mid latitude."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    dx = (lon1 - lon2) * M_PER_DEG * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(dx, (lat1 - lat2) * M_PER_DEG)


def segment_distance_m(lon, lat, ax, ay, bx, by) -> Column:
    """Point to segment distance in metres, locally flat around the point."""
    lon, lat, ax, ay, bx, by = map(col, (lon, lat, ax, ay, bx, by))
    kx = F.lit(M_PER_DEG) * F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    x0, y0 = (ax - lon) * kx, (ay - lat) * M_PER_DEG
    dx, dy = (bx - lon) * kx - x0, (by - lat) * M_PER_DEG - y0
    length2 = dx * dx + dy * dy
    along = F.when(length2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x0 * dx + y0 * dy) / F.nullif(length2, F.lit(0.0)))))
    return F.hypot(x0 + along * dx, y0 + along * dy)


def combined_uncertainty(a, b) -> Column:
    return F.hypot(col(a), col(b))


def cell_index(value, cell_deg: float) -> Column:
    """Lattice index: round to nine decimals first, then floor."""
    return F.floor(F.round(col(value) / F.lit(float(cell_deg)), 9)).cast("bigint")


def cosine_cell(lat, lon, cell_deg: float) -> Column:
    """struct(row, col) of a cell whose column width follows its row's cosine."""
    row = F.floor(col(lat) / cell_deg).cast("bigint")
    centre = (row + 0.5) * cell_deg
    return F.struct(row.alias("row"),
                    F.floor(col(lon) * F.cos(F.radians(centre)) / cell_deg).cast("bigint").alias("col"))


def cosine_cell_centre(row, column, cell_deg: float) -> Column:
    lat = (col(row) + 0.5) * cell_deg
    return F.struct(lat.alias("lat"), ((col(column) + 0.5) * cell_deg / F.cos(F.radians(lat))).alias("lon"))


def cell_area_km2(row, cell_deg: float) -> Column:
    """Approximate ground area of one lattice cell from its row."""
    lat = (col(row) + 0.5) * cell_deg
    return F.lit(cell_deg * 111.32) * F.cos(F.radians(lat)) * F.lit(cell_deg * 110.57)


def searched_cell_km2(row, level, cell_deg: float) -> Column:
    """Area of a searched cell weighted by its level."""
    lat = (col(row) + 0.5) * cell_deg
    side = cell_deg * M_PER_DEG / 1000.0
    return F.lit(side * side) * F.cos(F.radians(lat)) * col(level) / LEVELS


def box_overlap(a_lon0, a_lat0, a_lon1, a_lat1, b_lon0, b_lat0, b_lon1, b_lat1) -> Column:
    return ((col(a_lon0) <= col(b_lon1)) & (col(a_lon1) >= col(b_lon0))
            & (col(a_lat0) <= col(b_lat1)) & (col(a_lat1) >= col(b_lat0)))


def box_area_km2(lon0, lat0, lon1, lat1) -> Column:
    mid = F.cos(F.radians((col(lat0) + col(lat1)) / 2))
    return ((col(lon1) - col(lon0)) * 111.32 * mid) * ((col(lat1) - col(lat0)) * 110.57)


def buffer_box(lon0, lat0, lon1, lat1, metres: float) -> Column:
    """Grow a box; the longitude margin is scaled at the edge nearer a pole."""
    dlat = metres / M_PER_DEG
    pole = F.greatest(F.abs(col(lat0)), F.abs(col(lat1))) + dlat
    dlon = F.lit(dlat) / F.greatest(F.cos(F.radians(F.least(pole, F.lit(89.9)))), F.lit(0.01))
    return F.struct((col(lon0) - dlon).alias("lon0"), (col(lat0) - dlat).alias("lat0"),
                    (col(lon1) + dlon).alias("lon1"), (col(lat1) + dlat).alias("lat1"))


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """Sign of the cross product of AB and AC."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _between(ax, ay, bx, by, px, py) -> Column:
    ax, ay, bx, by, px, py = map(col, (ax, ay, bx, by, px, py))
    return ((px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx))
            & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by)))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """True where closed segments AB and CD share a point."""
    o1, o2 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    o3, o4 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    return (((o1 != o2) & (o3 != o4))
            | ((o1 == 0) & _between(ax, ay, bx, by, cx, cy))
            | ((o2 == 0) & _between(ax, ay, bx, by, dx, dy))
            | ((o3 == 0) & _between(cx, cy, dx, dy, ax, ay))
            | ((o4 == 0) & _between(cx, cy, dx, dy, bx, by)))


def crosses_ray(lon, lat, ax, ay, bx, by) -> Column:
    """Does the eastward ray from the point cross edge AB (even-odd rule)?"""
    lon, lat, ax, ay, bx, by = map(col, (lon, lat, ax, ay, bx, by))
    return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)


def degrees_for(metres: float) -> float:
    return metres / M_PER_DEG


def box_circle(lon0, lat0, lon1, lat1) -> Column:
    """Centre and radius (nm) of the circle that circumscribes a box."""
    clat, clon = (col(lat0) + col(lat1)) / 2, (col(lon0) + col(lon1)) / 2
    ns = (col(lat1) - col(lat0)) / 2 * 110.57
    ew = (col(lon1) - col(lon0)) / 2 * 111.32 * F.cos(F.radians(clat))
    return F.struct(clat.alias("lat"), clon.alias("lon"), (F.hypot(ns, ew) / 1.852).alias("radius_nm"))
