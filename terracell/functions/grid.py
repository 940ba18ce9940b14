"""Regular grids as column expressions: axes, cells, centres, ocean boxes, padding indices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """A regular axis: ``count`` bins of width ``step`` from ``start``."""

    start: float
    step: float
    count: int
    wrap: bool = False

    def index(self, value: Column, strict: bool = False, lower_checked: bool = False) -> Column:
        """Bin of a value: the quotient truncated toward zero, NULL outside.

        Truncation lets values up to one step below the start into bin 0, as the
        data this engine reproduces do; ``lower_checked`` turns that off. With
        ``wrap`` the value one past the end is bin 0. ``strict`` raises an error
        instead of NULL.
        """
        raw = (value - F.lit(self.start)) / F.lit(self.step)
        i = raw.cast("int")
        if self.wrap:
            i = F.when(i == self.count, F.lit(0)).otherwise(i)
        inside = (i >= 0) & (i < self.count)
        if lower_checked:
            inside = inside & (value >= self.start)
        out = F.when(inside, i)
        if strict:
            out = F.when(value.isNull() | inside, out).otherwise(F.raise_error(F.lit("value outside the axis")).cast("int"))
        return out

    def index_from_zeroth(self, value: Column) -> Column:
        """The same bin, computed from the centre one step before the first bin."""
        zeroth = self.start - 0.5 * self.step
        i = ((value - F.lit(zeroth)) / F.lit(self.step) - F.lit(0.5)).cast("int")
        return F.when((i >= 0) & (i < self.count), i)

    def centre(self, index: Column) -> Column:
        return F.lit(self.start) + F.lit(self.step) * (index + F.lit(0.5))

    def edge(self, index: Column) -> Column:
        return F.lit(self.start) + F.lit(self.step) * index


@dataclass(frozen=True)
class Grid:
    """Latitude and longitude axes; cell id = lat_idx * nlon + lon_idx."""

    lat: Axis
    lon: Axis

    @classmethod
    def global_grid(cls, resolution: float) -> Grid:
        return cls(Axis(-90.0, resolution, round(180 / resolution)), Axis(-180.0, resolution, round(360 / resolution), wrap=True))

    def cell(self, lat_index: Column, lon_index: Column) -> Column:
        return (lat_index.cast("bigint") * F.lit(self.lon.count) + lon_index).cast("bigint")

    def assign(self, df: DataFrame, lat: str = "lat", lon: str = "lon", strict: bool = False) -> DataFrame:
        """df with lat_idx, lon_idx and cell_id; rows outside the grid go (or raise, if strict)."""
        df = df.withColumn("lat_idx", self.lat.index(F.col(lat), strict)).withColumn("lon_idx", self.lon.index(F.col(lon), strict))
        df = df.where(F.col("lat_idx").isNotNull() & F.col("lon_idx").isNotNull())
        return df.withColumn("cell_id", self.cell(F.col("lat_idx"), F.col("lon_idx")))

    def lookup(self, spark: SparkSession) -> DataFrame:
        """Location table of all cell centres: location_id, latitude, longitude."""
        n = self.lon.count
        ids = spark.range(self.lat.count * n).withColumnRenamed("id", "location_id")
        row, col = F.floor(F.col("location_id") / n), F.pmod("location_id", F.lit(n))
        return ids.select("location_id", self.lat.centre(row).alias("latitude"), self.lon.centre(col).alias("longitude"))


def wrap_longitude(lon: Column) -> Column:
    """Longitudes from 180 on move to the western half."""
    return F.when(lon >= 180, lon - 360).otherwise(lon)


def ocean_box(lat: Column, lon: Column, resolution: float) -> tuple[Column, Column]:
    """Box indices with a nudge of 0.001 degrees; longitude wraps, latitude is clamped."""
    nlon, nlat = round(360 / resolution), round(180 / resolution)
    x = F.floor((lon + 0.001 + 180) / resolution)
    x = F.when(x >= nlon, 0).when(x < 0, nlon - 1).otherwise(x).cast("int")
    y = F.floor((lat + 0.001 + 90) / resolution)
    return F.greatest(F.lit(0), F.least(F.lit(nlat - 1), y)).cast("int"), x


def reflect(index: Column, n: int) -> Column:
    """Index of a row beyond an edge mirrored without repeating the edge."""
    return F.when(index < 0, -index).when(index >= n, 2 * (n - 1) - index).otherwise(index)
