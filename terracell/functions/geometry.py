"""Spherical geometry on columns: unit vectors, angles, area weights, barycentric coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
Vector = tuple[Column, Column, Column]


def to_vector(lat: Column, lon: Column) -> Vector:
    """Unit vector of latitude and longitude in degrees."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def to_degrees(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of a vector."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Vector, b: Vector) -> Column:
    """Angle in radians of two unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def latitude_span(km: Column) -> Column:
    return F.degrees(km / EARTH_RADIUS_KM)


def longitude_span(km: Column, lat: Column) -> Column:
    """Degrees of longitude that a distance covers at a latitude."""
    return F.degrees(km / (EARTH_RADIUS_KM * F.sin(F.radians(90 - lat))))


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def latitude_harmonics(lat: Column) -> list[tuple[str, Column]]:
    a = F.radians(lat)
    return [("cos_2", F.cos(2 * a)), ("sin_2", F.sin(2 * a)), ("cos_4", F.cos(4 * a)), ("sin_4", F.sin(4 * a))]


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    """Area of the plane triangle."""
    one = tuple(q - p for p, q in zip(a, b, strict=True))
    two = tuple(q - p for p, q in zip(a, c, strict=True))
    return norm(cross(one, two)) / 2


def barycentric(p: Vector, a: Vector, b: Vector, c: Vector) -> Vector:
    """Weights of a, b, c that put p's ray through the triangle's plane; they sum to 1."""
    wa, wb, wc = dot(p, cross(b, c)), dot(p, cross(c, a)), dot(p, cross(a, b))
    total = wa + wb + wc
    return wa / total, wb / total, wc / total


def circumcentre(a: Vector, b: Vector, c: Vector) -> Vector:
    """Unit vector at equal distance from three unit vectors."""
    n = cross(tuple(q - p for p, q in zip(a, b, strict=True)), tuple(q - p for p, q in zip(a, c, strict=True)))
    size = norm(n)
    return tuple(v / size for v in n)
