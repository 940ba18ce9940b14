"""The quality flags of a daily field: their bits, how each is set, how they mask."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.operators import filters, stencil


class Bit(IntEnum):
    """Bit numbers of the flags."""

    DAY = 0
    PRIOR_WINDOW = 1
    POST_WINDOW = 2
    PRIOR_CALENDAR = 3
    POST_CALENDAR = 4
    CLIMATOLOGY_UNC = 5
    LARGE_SCALE_UNC = 6
    AREAL_LOW = 7
    AREAL_HIGH = 8
    EXTREME_LOW = 9
    EXTREME_HIGH = 10
    PERSISTENT_OUTLIER = 11
    MISSING_MARINE = 12
    LOCATION_LOW = 13
    LOCATION_HIGH = 14
    MISSING = 15


CALENDAR_DAY = 1 << Bit.DAY | 1 << Bit.PRIOR_WINDOW | 1 << Bit.POST_WINDOW
OUTLIERS = 1 << Bit.AREAL_LOW | 1 << Bit.AREAL_HIGH | 1 << Bit.EXTREME_LOW | 1 << Bit.EXTREME_HIGH
# Fixed values: (bit that masks, bit that overrides it).
MASK_RULES: list[tuple[int, int | None]] = [
    (Bit.MISSING, Bit.MISSING_MARINE),
    (Bit.LARGE_SCALE_UNC, None),
    (Bit.CLIMATOLOGY_UNC, None),
    (Bit.AREAL_LOW, None),
    (Bit.AREAL_HIGH, None),
    (Bit.EXTREME_LOW, None),
    (Bit.EXTREME_HIGH, None),
    (Bit.LOCATION_LOW, None),
    (Bit.LOCATION_HIGH, None),
]
MARINE_FROM = 2013  # years in which missing sea cells mask too
EXTREME_LOWEST, EXTREME_HIGHEST = 193.15, 333.15


def flag(condition: Column, bit: int) -> Column:
    """The bit where the condition holds, else 0 (unknown: 0)."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(1 << bit)).otherwise(F.lit(0))


def combine(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out.cast("int")


def combine_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bit_or(column).cast("int").alias(column))


def names(column: Column) -> Column:
    """Array of the names of the set bits."""
    every = F.array(*[F.when(column.bitwiseAND(F.lit(1 << b)) != 0, F.lit(b.name)) for b in Bit])
    return F.filter(every, lambda x: x.isNotNull())


def masked(column: Column, year: Column) -> Column:
    """Whether the flags mask a cell: any rule, and from 2013 on the missing marine bit too."""
    return filters.any_rule(column, MASK_RULES) | ((year >= MARINE_FROM) & filters.any_rule(column, [(Bit.MISSING_MARINE, None)]))


def uncertainty_flag(df: DataFrame, keys: list[str], unc: str, nlat: int, nlon: int, width: int, bit: int, above: float = 0.5) -> DataFrame:
    """df with the flag where the window's mean uncertainty is too high (climatology: 13 cells, large scale: 17)."""
    return stencil.moving_mean(df, keys, unc, nlat, nlon, width, "_mean").withColumn("qc", flag(F.col("_mean") > above, bit)).drop("_mean")


def influence_flag(df: DataFrame, keys: list[str], influence: str, nlat: int, nlon: int, width: int = 5, below: float = 0.6) -> DataFrame:
    """df with the DAY flag where the window's mean observation influence is too low."""
    return stencil.moving_mean(df, keys, influence, nlat, nlon, width, "_mean").withColumn("qc", flag(F.col("_mean") < below, Bit.DAY)).drop("_mean")


def extreme_flags(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, width: int = 5) -> DataFrame:
    """df with the extreme flags, spread over the window around each extreme cell."""
    df = df.withColumns({"_low": F.coalesce(F.col(value) < EXTREME_LOWEST, F.lit(False)), "_high": F.coalesce(F.col(value) > EXTREME_HIGHEST, F.lit(False))})
    df = stencil.dilate(df, keys, "_low", nlat, nlon, width, "_dl")
    df = stencil.dilate(df, keys, "_high", nlat, nlon, width, "_dh")
    return df.withColumn("qc", combine(flag(F.col("_dl"), Bit.EXTREME_LOW), flag(F.col("_dh"), Bit.EXTREME_HIGH))).drop("_low", "_high", "_dl", "_dh")


def range_test(value: Column, q1: Column, q2: Column, q3: Column, factor: float) -> tuple[Column, Column]:
    """(low, high): whether a value leaves the median by more than ``factor`` quartile distances."""
    return F.coalesce(value < q2 - factor * (q2 - q1), F.lit(False)), F.coalesce(value > q2 + factor * (q3 - q2), F.lit(False))


def areal_flags(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, width: int, factor: float = 4.0, spread: int = 5) -> DataFrame:
    """df with the areal outlier flags: beyond the window's quartiles by four quartile distances, dilated."""
    q = stencil.moving_quartiles(df, keys, value, nlat, nlon, width)
    low = F.coalesce(F.col(value) < F.col("q1") - factor * (F.col("q2") - F.col("q1")), F.lit(False))
    high = F.coalesce(F.col(value) > F.col("q3") + factor * (F.col("q3") - F.col("q2")), F.lit(False))
    q = q.withColumns({"_low": low, "_high": high})
    q = stencil.dilate(q, keys, "_low", nlat, nlon, spread, "_dl")
    q = stencil.dilate(q, keys, "_high", nlat, nlon, spread, "_dh")
    return q.withColumn("qc", combine(flag(F.col("_dl"), Bit.AREAL_LOW), flag(F.col("_dh"), Bit.AREAL_HIGH))).drop("_low", "_high", "_dl", "_dh", "q1", "q2", "q3")


def location_flags(df: DataFrame, climate: DataFrame, keys: list[str], value: str, factor: float = 8.0) -> DataFrame:
    """df with the location flags from quartiles per cell and calendar day (q1, q2, q3); where these are missing, no flag."""
    low, high = range_test(F.col(value), F.col("q1"), F.col("q2"), F.col("q3"), factor)
    return df.join(climate, keys, "left").withColumn("qc", combine(flag(low, Bit.LOCATION_LOW), flag(high, Bit.LOCATION_HIGH)))


def latent_flag(design: DataFrame, constraint: DataFrame, bit: int, below: float = 0.2) -> DataFrame:
    """Rows of a design matrix (row, col, value) that touch a weakly constrained parameter."""
    weak = constraint.where(F.col("constraint") < below).select("col")
    hit = design.join(weak, "col", "left_semi").groupBy("row").agg(F.sum("value").alias("s"))
    return hit.select("row", flag(F.col("s") > 0, bit).alias("qc"))
