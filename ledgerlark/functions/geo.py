"""Geometry in built-in expressions: rings and polygons of [lon, lat] points, boxes and distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POLYGONS = "array<array<array<array<double>>>>"


def ring_center(ring: Column) -> Column:
    """(lon, lat) mean of a ring's points, the closing one counted."""
    mean = lambda i: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, p: s + F.element_at(p, i)), F.size(ring))
    return F.struct(mean(1).alias("lon"), mean(2).alias("lat"))


def polygons_center(polygons: Column) -> Column:
    """(lon, lat) mean of the outer rings' centers of a multi-polygon."""
    centers = F.transform(polygons, lambda p: ring_center(F.element_at(p, 1)))
    mean = lambda part: F.try_divide(F.aggregate(centers, F.lit(0.0), lambda s, c: s + c[part]), F.size(centers))
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def feature(geometry_type: str, coordinates: Column, properties: Column) -> Column:
    """GeoJSON feature text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6,371 km."""
    rad = F.radians
    a = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))
