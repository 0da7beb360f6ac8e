"""Column expressions for positions on the sphere and for small planar geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance from an edge within which a point counts as on it, in degrees.
EDGE_TOLERANCE = 1e-10
#: A mean of unit vectors that is shorter is rounding noise and points nowhere.
NO_DIRECTION = 1e-9


def canonical_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180), rounded to ten decimals, no negative zero."""
    wrapped = F.round(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0, 10)
    return F.when(wrapped >= 180.0, -180.0).otherwise(wrapped) + 0.0


def in_bounds(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive box; west > east crosses the antimeridian. Only the branch that applies is emitted, so it is pushed down."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def in_polygon(lat: Column, lon: Column, polygon: list[tuple[float, float]]) -> Column:
    """Points (lat, lon) inside a polygon or on its boundary; edges must span less than 180 degrees of longitude."""
    edges = list(zip(polygon, polygon[1:] + polygon[:1], strict=True))
    if len(polygon) < 3 or any(abs(a[1] - b[1]) > 180 for a, b in edges):
        raise ValueError("a polygon needs three corners and edges under 180 degrees")
    on_edge, crossings = [], []
    for (y1, x1), (y2, x2) in edges:
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        inside = lat.between(min(y1, y2) - EDGE_TOLERANCE, max(y1, y2) + EDGE_TOLERANCE) & lon.between(min(x1, x2) - EDGE_TOLERANCE, max(x1, x2) + EDGE_TOLERANCE)
        on_edge.append((F.abs(cross) <= EDGE_TOLERANCE) & inside)
        if y1 != y2:
            spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            crossings.append(F.when(spans & (lon < x1 + (lat - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0))
    box = lat.between(min(p[0] for p in polygon), max(p[0] for p in polygon)) & lon.between(min(p[1] for p in polygon), max(p[1] for p in polygon))
    return box & (reduce(lambda a, b: a | b, on_edge) | (reduce(lambda a, b: a + b, crossings) % 2 == 1))


def speed_and_bearing(east: Column, north: Column) -> tuple[Column, Column]:
    """Speed, and bearing clockwise from north in [0, 360)."""
    return F.hypot(east, north), F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def circular_mean_longitude(lon: Column) -> Column:
    """Aggregate: the direction of the mean unit vector; 180 is given as -180. Longitudes that cancel out have none."""
    east, north = F.avg(F.sin(F.radians(lon))), F.avg(F.cos(F.radians(lon)))
    mean = F.degrees(F.atan2(east, north))
    return F.when(F.hypot(east, north) < NO_DIRECTION, F.lit(None)).when(F.abs(mean) >= 180.0 - 1e-9, -180.0).otherwise(mean)
