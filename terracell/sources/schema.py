"""Canonical table schemas, as DDL text."""

from __future__ import annotations

from pyspark.sql import types as T

OBS = "source string, observable string, day int, location_id bigint, measurement double, unc double, unc_corr array<double>"
LOCATION = "lookup_id string, location_id bigint, latitude double, longitude double"
BREAKS = "break_index int, station int, break_day int, likelihood int"
CORRELATION_RANGE = "source string, observable string, idx int, range double"
STATION = "station_code string, station int, latitude double, longitude double, elevation double, day int, tasmin double, tasmax double, tasmin_qc int, tasmax_qc int"
FIELD = "day int, lat_idx int, lon_idx int, tas double, tasuncertainty double, tasobservationinfluence double, ensemble array<double>"
ICE_INPUT = (
    "lat double, lon double, surface_temperature double, surface_temperature_min double, surface_temperature_max double, surface_temperature_std double, land_mask int, "
    "sea_ice_fraction double, uncorrelated_uncertainty double, synoptically_correlated_uncertainty double, large_scale_correlated_uncertainty double"
)
CATALOGUE = "dataset string, subset int, entry int, path string, time timestamp, tags array<string>, checksum bigint, size bigint"


def described(field: T.StructField, **metadata) -> T.StructField:
    """A field with metadata (units, packing, correlation ranges)."""
    return T.StructField(field.name, field.dataType, field.nullable, {**(field.metadata or {}), **metadata})
