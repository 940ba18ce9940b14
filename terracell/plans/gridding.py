"""Satellite gridding: quality filter, binning, statistics and uncertainty of each cell, packing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions.grid import Grid
from terracell.functions.physics import TEMPERATURE
from terracell.operators import aggregate, filters


@dataclass(frozen=True)
class Quality:
    """Two bit filters: ``observed`` pixels count, ``valid`` ones enter the statistics."""

    observed_mask: int = 1
    observed: int = 1
    valid_mask: int = 7
    valid: int = 1


def grid_day(pixels: DataFrame, grid: Grid, quality: Quality, keys: tuple[str, ...] = (), value: str = "measurement") -> DataFrame:
    """The aggregate field of all pixels: one scan, one partial aggregate, one shuffle of cells."""
    qc = F.col("qc")
    rows = pixels.where(filters.bits_match(qc, quality.observed_mask, quality.observed) & filters.coordinates_valid(F.col("lat"), F.col("lon")))
    binned = grid.assign(rows)
    valid = filters.bits_match(qc, quality.valid_mask, quality.valid)
    out = aggregate.grid_surface(binned, [*keys, "lat_idx", "lon_idx", "cell_id"], value, valid)
    return out.withColumn("ts_packed", TEMPERATURE.pack(F.col("ts_mean")))


def grid_time_blocks(pixels: DataFrame, grid: Grid, quality: Quality) -> DataFrame:
    """Fields per day, for any number of days in one plan."""
    return grid_day(pixels, grid, quality, keys=("day",))
