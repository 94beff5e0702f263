"""Distances on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.col(x) if isinstance(x, str) else x for x in (lat1, lng1, lat2, lng2))
    lat, lng = F.radians(c - a), F.radians(d - b)
    h = F.pow(F.sin(lat / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(lng / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """The same for plain numbers, as the order-dependent folds need it."""
    lat, lng = math.radians(lat2 - lat1), math.radians(lng2 - lng1)
    h = math.sin(lat / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(lng / 2) ** 2
    return 2 * EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def missing(lat, lng) -> Column:
    """Whether a place counts as unlocated: a coordinate that is null or 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (lat, lng))
    return (F.coalesce(a, F.lit(0.0)) == 0) | (F.coalesce(b, F.lit(0.0)) == 0)
