"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371008.8  # metres


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Whole metres, cut off."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return (2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))).cast("long")


def within(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[2]) & lng.between(box[1], box[3])
