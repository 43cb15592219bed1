"""Places on the globe: distances and weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6372797.6  # metres
MILE = 1609.344


def miles_to_metres(x):
    return x * MILE


def metres_to_miles(x):
    return x / MILE


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.isNotNull()


def normalised_longitude(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def distance(lat1: Column, lon1: Column, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat2, lon2))
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = F.sin((a - b) / 2), F.sin(F.radians(lon1 - lon2) / 2)
    h = F.least(F.lit(1.0), dlat * dlat + dlon * dlon * F.cos(a) * F.cos(b))
    return 2 * RADIUS * F.asin(F.sqrt(h))


def nearest(places: Column, lat: float, lon: float) -> Column:
    """Least distance of an array of (lat, lon) to a place; null without places."""
    return F.array_min(F.transform(places, lambda p: distance(p["lat"], p["lon"], lat, lon)))


def weight(dist: Column, k1: float = 1000.0, k2: float = 1.0) -> Column:
    return k1 * F.pow(dist + k1, F.lit(-k2))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box, which may reach over the date line: a cheap filter before distances."""
    l, w, e = F.pmod(lon, F.lit(360.0)), west % 360, east % 360
    return lat.between(south, north) & (l.between(w, e) if w <= e else (l >= w) | (l <= e))


def source(coordinates, centre: tuple[float, float], max_range: float = 0.0, k1: float = 1000.0, k2: float = 1.0):
    """A posting source over coordinates (did, places): documents within the range, weighted by distance."""

    def f(_catalog):
        x = coordinates.where("size(places) > 0").withColumn("dist", nearest(F.col("places"), *centre))
        if max_range:
            x = x.where(F.col("dist") <= max_range)
        return x.select("did", weight(F.col("dist"), k1, k2).alias("w"))

    return f
