"""Distances between positions and shapes, and bearing.  x is latitude, y longitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernel

# Kilometres a degree, and the earth's radius in kilometres and nautical miles.
KM_PER_DEGREE = 111.195083724
RADIUS = {"km": 6371.0, "nm": 3440.06}


def pythagorean_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def pythagorean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance in kilometres."""
    return pythagorean_degrees(x1, y1, x2, y2) * KM_PER_DEGREE


def greatcircle(x1: Column, y1: Column, x2: Column, y2: Column, unit: str = "nm") -> Column:
    """Haversine distance, in nautical miles unless told otherwise."""
    if unit not in RADIUS:
        raise ValueError(f"unit {unit!r}: known are {sorted(RADIUS)}")
    h1, h2 = F.sin(F.radians(x2 - x1) / 2), F.sin(F.radians(y2 - y1) / 2)
    a = h1 * h1 + F.cos(F.radians(x1)) * F.cos(F.radians(x2)) * h2 * h2
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * RADIUS[unit]


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Initial bearing in degrees, from -180 (not included) to 180."""
    dy = F.radians(y2 - y1)
    across = F.sin(dy) * F.cos(F.radians(x2))
    ahead = F.cos(F.radians(x1)) * F.sin(F.radians(x2)) - F.sin(F.radians(x1)) * F.cos(F.radians(x2)) * F.cos(dy)
    return F.degrees(F.atan2(across, ahead))


def _points_only(a: Column, b: Column, value: Column) -> Column:
    return F.when((a["kind"] == "point") & (b["kind"] == "point"), value)


def _xy(shape: Column) -> tuple[Column, Column]:
    p = shape["rings"][0][0]
    return p["x"], p["y"]


def shape_pythagorean(a: Column, b: Column) -> Column:
    """Kilometres between points; null for other shapes."""
    return _points_only(a, b, pythagorean(*_xy(a), *_xy(b)))


def shape_greatcircle(a: Column, b: Column, unit: str = "nm") -> Column:
    return _points_only(a, b, greatcircle(*_xy(a), *_xy(b), unit))


def shape_bearing(a: Column, b: Column) -> Column:
    return _points_only(a, b, bearing(*_xy(a), *_xy(b)))


def shape_distance(a: Column, b: Column) -> Column:
    """Kilometres between any two shapes; 0 if they are equal or intersect."""
    return kernel.distance(a, b) * KM_PER_DEGREE
