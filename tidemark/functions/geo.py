"""Distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6378.137 km."""
    return haversine_km(lat1, lon1, lat2, lon2, 6378.137) * 1000


def planar_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance in a plane of 110.25 km a degree. The second difference is scaled by the cosine of the second point's x taken in
    radians although it is in degrees; results that must agree with kept ones depend on it."""
    dx, dy = x2 - x1, (y2 - y1) * F.cos(x2)
    return F.lit(110.25) * F.sqrt(dx * dx + dy * dy)
