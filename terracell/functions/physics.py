"""Unit conversions, altitude corrections, packing to integers, basis functions, solar position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN = 273.15
# Lapse rates in kelvin per kilometre.
LAPSE_RATE, LAPSE_UNCERTAINTY, QC_LAPSE_RATE = -6.5, 1.1, -4.5


def altitude_adjustment(altitude_km: Column, reference_km: Column) -> Column:
    return -F.lit(LAPSE_RATE) * (altitude_km - reference_km)


def altitude_uncertainty(altitude_km: Column, reference_km: Column) -> Column:
    return F.lit(LAPSE_UNCERTAINTY) * F.abs(altitude_km - reference_km)


def quadrature(*parts: Column) -> Column:
    """Root of the sum of squares."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def remove_altitude(value: Column, altitude_km: Column) -> Column:
    """A field as it would be at sea level, for outlier checks."""
    return value - F.lit(QC_LAPSE_RATE) * altitude_km


@dataclass(frozen=True)
class Packing:
    """How a variable is stored as an integer."""

    scale: float
    offset: float
    fill: int = -32768
    kind: str = "int"

    def pack(self, value: Column) -> Column:
        return F.coalesce(F.round((value - self.offset) / self.scale).cast(self.kind), F.lit(self.fill).cast(self.kind))

    def unpack(self, packed: Column) -> Column:
        return F.when(packed != self.fill, packed * self.scale + self.offset)


# Storage of the product's variables.
TEMPERATURE = Packing(0.005, 273.15)
UNCERTAINTY = Packing(0.001, 0.0)
FRACTION = Packing(1.5625e-05, 0.5)


def wendland4(r: Column) -> Column:
    """Wendland's C4 basis function of relative distance; 0 from 1 on, 1 at 0."""
    return F.when(r < 1, F.pow(1 - r, 6) * (35 * r * r + 18 * r + 3) / 3).otherwise(0.0)


def hat(distance: Column, span: float) -> Column:
    """Piecewise linear basis function."""
    return F.greatest(F.lit(0.0), 1 - F.abs(distance) / span)


def solar_declination(day_of_year: Column) -> Column:
    """Declination in radians by the usual seven-term series."""
    g = 2 * F.pi() * (day_of_year - 1) / 365
    return 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)


def equation_of_time(day_of_year: Column) -> Column:
    """Minutes by which the sun is ahead of the clock."""
    g = 2 * F.pi() * (day_of_year - 1) / 365
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def solar_noon_hour(day_of_year: Column, lon: Column) -> Column:
    """Hour of the day (UTC) at which the sun is highest."""
    return 12 - lon / 15 - equation_of_time(day_of_year) / 60


def solar_zenith(day_of_year: Column, hour: Column, lat: Column, lon: Column) -> Column:
    """Zenith angle in degrees."""
    d, phi = solar_declination(day_of_year), F.radians(lat)
    h = F.radians((hour - solar_noon_hour(day_of_year, lon)) * 15)
    c = F.sin(phi) * F.sin(d) + F.cos(phi) * F.cos(d) * F.cos(h)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
