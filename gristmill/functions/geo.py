"""Points on the sphere as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the Earth in km.
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km; antipodes, where rounding would leave asin's domain, give half the circumference."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    s, t = F.sin(dlat / 2), F.sin(dlng / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_xyz(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """The point on the unit sphere."""
    p, q = F.radians(lat), F.radians(lng)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def squared_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Squared straight-line distance of two points given by their coordinates."""
    parts = [(x - y) * (x - y) for x, y in zip(a, b)]
    return sum(parts[1:], parts[0])


def squared_distance_to_box(p: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    """Squared straight-line distance of a point to an axis-parallel box; 0 inside."""
    gaps = [F.greatest(lo - v, v - hi, F.lit(0.0)) for v, lo, hi in zip(p, low, high)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def chord(km: float) -> float:
    """Straight-line distance on the unit sphere of points so far apart; at most 2."""
    return 2 * math.sin(min(max(km / EARTH_KM, 0.0), math.pi) / 2)


def squared_chord(km: Column) -> Column:
    """Square of chord() for a column; distances below 0 and beyond half the circumference are cut off."""
    half = F.sin(F.least(F.greatest(km / EARTH_KM, F.lit(0.0)), F.lit(math.pi)) / 2)
    return 4 * half * half


def is_valid(lat: Column, lng: Column) -> Column:
    """Whether both coordinates are there and in range; NaN isn't."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))
